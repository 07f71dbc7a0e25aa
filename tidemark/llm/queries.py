"""The numbered operators as queries over whole tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontamination, fill_in_middle, fingerprints, jaccard_join, licenses, packing, pii, quality, sentencepiece_codec, substring_dedup, toxicity, url_filters
from tidemark.llm.common import table

#: The contract's rules decide first (tier 0); then a list of ad and spam hosts (tier 1).
URL_RULES = [
    ("net", "/", "block", 0),
    ("example.net", "/en/", "allow", 0),
    ("example.com", "/de/", "block", 0),
    ("org", "/fr/", "allow", 0),
    ("ads-track.example.org", "/", "block", 1),
    ("cheap-pills.example.com", "/", "block", 1),
    ("spam-farm.example.org", "/", "block", 1),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.rules_table(spark, URL_RULES))
    own = F.col("tier") == 0
    return judged.select("page_id", "host", "path", F.when(own, F.col("rule")).alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("rule")).alias("list_rule"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("parts")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_parts")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = list(pii.KINDS)
    n = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kinds.index(kind))).cast("long")
    base = F.filter("pii", lambda x: x["kind"] < len(pii.BASE))
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in kinds[: len(pii.BASE)]], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"), n("secret").alias("n_secret"), F.array_join(F.transform("pii", lambda x: F.round(x["score"], 1).cast("string")), ",").alias("scores"),
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", "n_ids", "round_trip", "decoded_sha256", "ids")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_document_fingerprints, op3_benchmark_decontamination, op4_pii, op5_license_scans,
        op6_quality_classifier, op7_toxicity, op8_sentencepiece, op9_ngram_jaccard_join, op10_substring_dedup,
        op11_tokenizer_alignment, op12_packing, op13_fill_in_middle,
    )
}


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _url_sql() -> str:
    return f"""WITH rules(h, p, v, tier) AS (VALUES {_values(URL_RULES)}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u),
k AS (SELECT row_number() OVER () AS k, page_id, translate(raw, '{url_filters.UPPER}', '{url_filters.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
f AS (SELECT k, h || p AS rule, v, tier, row_number() OVER (PARTITION BY k ORDER BY tier, length(h || p) DESC, length(h) DESC, v) AS r FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) AND host <> '')
SELECT page_id, host, path, CASE WHEN tier = 0 THEN rule END AS rule, coalesce(v, 'allow') AS verdict, CASE WHEN tier = 1 THEN rule END AS list_rule FROM k LEFT JOIN f ON k.k = f.k AND r = 1"""


def _license_sql() -> str:
    rows, whole = licenses.postings(licenses.TEMPLATES, 1.0)
    keys = [(k, f" {p} ") for k, (_, _, ps) in enumerate(licenses.TEMPLATES) for p in ps]
    starts = " || ".join(
        f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {n}] = ' + repr(x) for n, x in enumerate(p.split(' '), 1))})" for p, _ in licenses.PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(j, ' {p} ') THEN '{label}' END" for p, label in licenses.PHRASES)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}'), '{licenses.WORD}') AS w FROM documents),
b AS (SELECT k, doc_id, w, ' ' || coalesce(array_to_string(w, ' '), '') || ' ' AS j FROM d),
s AS (SELECT *, {starts} AS st, list_sort(list_distinct(list_filter([{base}], lambda x: x IS NOT NULL))) AS bl FROM b),
ix(word, t, place, idf) AS (VALUES {_values(rows)}), tw(t, whole, label) AS (VALUES {_values([(k, v, licenses.TEMPLATES[k][0]) for k, v in enumerate(whole)])}), ky(t, p) AS (VALUES {_values(keys)}),
ok AS (SELECT DISTINCT k, t FROM b JOIN ky ON contains(j, p)),
ex AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS pos FROM b WHERE k IN (SELECT k FROM ok)),
hit AS (SELECT DISTINCT ex.k, ix.t, pos - place AS off, place, idf FROM ex JOIN ix USING (word) JOIN ok ON ok.k = ex.k AND ok.t = ix.t),
sh AS (SELECT hit.k, hit.t, off, round(sum(idf) / any_value(whole), 6) AS share, any_value(label) AS label FROM hit JOIN tw USING (t) GROUP BY 1, 2, 3),
be AS (SELECT k, max(share) AS score, list_distinct(list(label)) AS more, count(*) AS n FROM sh WHERE share >= 0.6 GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(st) AS BIGINT) AS n_base, CAST(list_min(st) AS BIGINT) AS first_word, CAST(list_max(st) AS BIGINT) AS last_word, array_to_string(bl, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(bl || coalesce(more, []))), ',') AS labels, CAST(CASE WHEN len(bl) > 0 THEN 1.0 ELSE coalesce(score, 0) END AS DOUBLE) AS score, coalesce(n, 0) AS template_hits FROM s LEFT JOIN be USING (k)"""


def _fill_in_middle_sql() -> str:
    h = [f"CAST('0x' || substr(sha, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    units = lambda k: f"array_to_string(p[1:{k}], chr(10)) || CASE WHEN {k} > 0 AND {k} < len(p) THEN chr(10) ELSE '' END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha FROM documents),
s AS (SELECT *, string_split(text, chr(10)) AS p, {', '.join(f'{x} AS h{k}' for k, x in enumerate(h, 1))} FROM d),
n AS (SELECT *, CAST(len(p) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n FROM s),
k AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS INT) AS ka, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS INT) AS kb,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
c AS (SELECT *, {units('ka')} AS head, {units('kb')} AS upto FROM k),
o AS (SELECT *, substr(upto, length(head) + 1) AS mid, substr(text, length(upto) + 1) AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""


ORACLE_SQL: dict[str, str] = {"op1_url_filters": _url_sql(), "op5_license_scans": _license_sql(), "op13_fill_in_middle": _fill_in_middle_sql()}
