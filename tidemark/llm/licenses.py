"""License scans: a positional rare-token index over licence templates.

Every file's rare licence words are looked up in the templates' postings; postings of one template that
agree on the relative position add up their IDF weight; the template is accepted if enough of its weight
lines up and one of its mandatory key phrases stands in the file.

Handling of edge cases: a null text counts as empty (no words, score 0); a very long text is searched whole; repeated
rows each keep their row; equal scores list all their labels; an empty table gives an empty result; further input
columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.url_filters import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, wording of the notice, mandatory key phrases (any of them).
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0", "cc by 3 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0", "creative commons attribution 3 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission", ["all rights reserved"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers from 0 at which the phrase's words stand consecutively."""
    ps = phrase.split(" ")

    def here(w: Column, i: Column) -> Column:
        hit = w == ps[0]
        for k, p in enumerate(ps[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return F.when(hit, i)

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def postings(templates: list[tuple[str, str, list[str]]], min_idf: float) -> tuple[list[tuple[str, int, int, float]], list[float]]:
    """(word, template, position, idf) of each template's rare words, and each template's whole weight.

    IDF counts templates. A template all of whose words are common keeps its rarest ones.
    """
    texts = [t.split(" ") for _, t, _ in templates]
    df = Counter(w for ws in texts for w in set(ws))
    idf = {w: math.log(len(texts) / n) for w, n in df.items()}
    out, whole = [], []
    for k, ws in enumerate(texts):
        cut = min(min_idf, sorted((idf[w] for w in ws), reverse=True)[min(2, len(ws) - 1)])
        own = [(w, k, p, max(idf[w], 0.01)) for p, w in enumerate(ws) if idf[w] >= cut]
        out += own
        whole.append(sum(x[3] for x in own))
    return out, whole


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, min_idf: float = 1.0, min_share: float = 0.6) -> DataFrame:
    """-> (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, template_hits), one row per input row.

    Only texts that hold the longest word of some key phrase can be accepted, so only those meet the index;
    this loses nothing. The index has a few hundred postings, a fixed list, and is broadcast.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_low", F.translate("_t", UPPER, LOWER))
    base_last = sorted({p.rsplit(" ", 1)[-1] for p, _ in phrases})
    may_base = _contains_any(F.col("_low"), base_last)
    none = F.array().cast("array<int>")
    starts = [F.when(may_base, phrase_starts(F.col("_w"), p)).otherwise(none) for p, _ in phrases]
    found = d.withColumn("_w", F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))).select(
        id_col, F.xxhash64("_t").alias("_key"), F.size("_w").cast("long").alias("n_words"), *[s.alias(f"_s{k}") for k, s in enumerate(starts)]
    )
    every = F.concat(*[F.col(f"_s{k}") for k in range(len(phrases))])
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_s{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    found = found.select(
        id_col, "_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("_base")
    )

    rows, whole = postings(templates, min_idf)
    index = F.broadcast(spark.createDataFrame(rows, "_word string, _template int, _at int, _idf double"))
    telling = sorted({max(p.split(" "), key=len) for _, _, ks in templates for p in ks})
    rare = sorted({r[0] for r in rows})
    could = d.where(_contains_any(F.col("_low"), telling))
    # what is bound in a lambda is computed once; words hold no blank, so joined by blanks they tell consecutive ones
    held = F.transform(F.array(F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))), lambda w: F.struct(w.alias("w"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("j")))
    key_ok = lambda j: F.array(*[F.array_contains(F.array(*[F.contains(j, F.lit(f" {p} ")) for p in ks]), True) for _, _, ks in templates])
    held = F.transform(held, lambda x: F.struct(x["w"].alias("w"), key_ok(x["j"]).alias("ok")))
    could = could.select(F.col(id_col), F.xxhash64("_t").alias("_key"), F.explode(F.filter(held, lambda x: F.array_contains(x["ok"], True))).alias("_x"))
    could = could.select(id_col, "_key", F.col("_x.w").alias("_w"), F.col("_x.ok").alias("_ok"))
    hits = (
        could.select(id_col, "_key", "_ok", F.posexplode("_w").alias("_pos", "_word"))
        .where(F.col("_word").isin(rare))
        .join(index, "_word")
        .where(F.get("_ok", F.col("_template")))
        .groupBy(id_col, "_key", "_template", (F.col("_pos") - F.col("_at")).alias("_offset"))
        .agg(F.collect_set(F.struct("_at", "_idf")).alias("_set"))
        .withColumn("_sum", F.aggregate("_set", F.lit(0.0), lambda a, x: a + x["_idf"]))
    )
    names, wholes = F.array(*[F.lit(t[0]) for t in templates]), F.array(*[F.lit(w) for w in whole])
    share = F.round(F.col("_sum") / F.get(wholes, F.col("_template")), 6)
    best = (
        hits.withColumn("_share", share)
        .where(F.col("_share") >= min_share)
        .groupBy(id_col, "_key")
        .agg(F.max("_share").alias("_score"), F.collect_set(F.get(names, F.col("_template"))).alias("_more"), F.countDistinct("_template", "_offset").alias("_n"))
    )
    best = best.withColumnsRenamed({id_col: "_id", "_key": "_k"})
    joined = found.join(best, (F.col("_key") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"), F.coalesce("_n", F.lit(0)).cast("long").alias("template_hits"),
    )


def _contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text may hold one of the words: long ones anywhere, short ones (common as parts of others) standing alone."""
    out = F.lit(False)
    for w in words:
        out = out | (F.contains(text, F.lit(w)) if len(w) > 3 else F.contains(text, F.lit(w)) & text.rlike(f"(?<![0-9a-z\\x80-\\x{{10FFFF}}]){w}(?![0-9a-z\\x80-\\x{{10FFFF}}])"))
    return out
