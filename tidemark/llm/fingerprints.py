"""Document fingerprints by I-Match: terms within an inverse-document-frequency band, sorted and distinct, hashed over randomised lexicon subsets.

A subset is a random share of the lexicon; the shares differ (1/8 to 1/512, eight subsets each), so that a
text of any length has some subsets that hold few of its terms. Texts that differ in part agree on the subsets
that the change missed: the share of agreeing subsets is the likeness of two fingerprints.

Handling of edge cases: a null text counts as empty; a text without a term in the band is fingerprinted by all
its terms, an empty one has 32 empty parts; two empty texts are alike (1); repeated rows each keep their row;
an empty table gives an empty result; further columns are dropped. Null ids come before all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, dealt, in_bitmap, small, stash, successors, with_bitmap

LEVELS = (3, 5, 7, 9)  # a subset of level b holds 2**-b of the lexicon
PER_LEVEL = 8
BITS, PROBES = 20, 2  # of the lexicon's bitmap: 128 KB


def terms_of(text: Column) -> Column:
    """Hashes of the distinct lower-cased terms, sorted."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.001, high: float = 0.05) -> tuple[DataFrame, int]:
    """One row holding a bitmap of the terms that stand in a share of the documents from `low` to `high`, and its bits.

    Document frequencies are exact, over all documents; equal texts are counted with their number. The band
    has at most (mean distinct terms of a document) / low terms, whatever the number of documents, so the
    bitmap is bounded. It also admits a few terms outside the band (below 1 in 100), always the same ones.
    """
    n = docs.count()
    per_doc = docs.select(F.explode(terms_of(F.coalesce(F.col(text_col), F.lit("")))).alias("_term"))
    df = per_doc.groupBy("_term").agg(F.count("*").alias("_n"))
    band = df.where((F.col("_n") >= max(2, low * n)) & (F.col("_n") <= max(2, high * n))).select("_term")
    bits = 1 << BITS
    return stash(bitmap(band, "_term", bits, PROBES)), bits


def fingerprint(text: Column, words: Column, bits: int) -> Column:
    """array<int> of one hash a subset, null for a subset without terms of the text."""
    terms = terms_of(text)

    def of_level(kept: Column, level: int) -> Column:
        slot = lambda t: F.shiftrightunsigned(t, 6 + 5 * (level // 2)).bitwiseAND(F.lit((1 << level) - 1))
        numbers = F.array(*[F.lit(k) for k in range(PER_LEVEL)])
        some = F.transform(F.array(F.filter(kept, lambda t: slot(t) < PER_LEVEL)), lambda few: F.transform(numbers, lambda k: _hash(F.filter(few, lambda t: slot(t) == k))))
        return F.get(some, F.lit(0))

    def parts(kept: Column) -> Column:
        return F.flatten(F.array(*[of_level(kept, level) for level in LEVELS]))

    # one-element arrays stand for variables: what is bound in a lambda is computed once
    band = F.transform(F.array(terms), lambda t: F.struct(t.alias("all"), F.filter(t, lambda x: in_bitmap(words, x, bits, PROBES)).alias("band")))
    chosen = F.transform(band, lambda b: parts(F.when(F.size(b["band"]) > 0, b["band"]).otherwise(b["all"])))
    return F.get(chosen, F.lit(0))


def _hash(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.hash(terms))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets among those in which either text has terms; 1 if neither has any."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False))))
    n = F.size(F.filter(both, lambda x: x.isNotNull()))
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(both, lambda x: x)) / n)


def as_text(parts: Column) -> Column:
    """Eight hex digits a subset, `-` for an empty one, dot-joined."""
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.right(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit(8)), F.lit("-"))), ".")


def with_next(docs: DataFrame, id_col: str, carry: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, per_bucket: int = 500) -> DataFrame:
    """Each row with the next row's `carry` columns (as next_*), by ascending id; the last row's next is the first.

    `derive` adds columns, computed once for each row and each copy before the rows are dealt. Rows that share an id come
    in the order of a hash of their first `carry` column, then of that column.

    The rows are dealt once, to buckets of neighbours by id and hash, whose numbers are counted first: no bucket holds
    more than four times `per_bucket` rows, but for rows that agree in both. Every bucket also gets a copy of the row
    that follows its last one, so a window over the bucket sees all successors.
    """
    keys = ["_k", "_h"]
    low = docs.agg(F.min(F.col(id_col).cast("bigint"))).first()[0] or 0
    bucketed = dealt(docs.withColumn("_k", F.coalesce(F.col(id_col).cast("bigint"), F.lit(low - 1))).withColumn("_h", F.xxhash64(carry[0])), keys, per_bucket)
    firsts = stash(bucketed.groupBy("_b").agg(F.min(F.struct(*keys)).alias("_first")).select(F.col("_b").alias("_to"), "_first.*"))
    ghosts_at = firsts.join(successors(firsts.select(*keys), keys=tuple(keys)), keys).select("_to", F.col("next__k").alias("_k"), F.col("next__h").alias("_h"))
    # rows that agree in both keys have equal texts: one of them follows
    some = bucketed.drop("_b").join(small(ghosts_at), keys).groupBy("_to", *keys).agg(*[F.any_value(c).alias(c) for c in docs.columns])
    ghosts = some.withColumnRenamed("_to", "_b").withColumn("_ghost", F.lit(1))
    both = derive(bucketed.withColumn("_ghost", F.lit(0)).unionByName(ghosts))
    w = Window.partitionBy("_b").orderBy("_ghost", *keys, F.col(carry[0]).asc_nulls_first())
    led = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
    return led.where("_ghost = 0").drop("_ghost", "_b", *keys)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.001, high: float = 0.05) -> DataFrame:
    """-> (id_col, text, parts): each document's text (null as empty) and fingerprint array."""
    words, bits = lexicon(docs, text_col, low, high)
    return _with_parts(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", words, bits)


def _with_parts(df: DataFrame, text_col: str, words: DataFrame, bits: int, out: str = "parts") -> DataFrame:
    held = with_bitmap(df, F.length(text_col) > 0, words)
    return held.select(*df.columns, fingerprint(F.col(text_col), F.col("_bitmap"), bits).alias(out))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.001, high: float = 0.05) -> DataFrame:
    """-> (id_col, n_chars, edited, parts, edited_parts, near_edited, near_next).

    `edited`: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    """
    words, bits = lexicon(docs, text_col, low, high)
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    led = with_next(own, id_col, ["text", "parts"], lambda df: _with_parts(df, "text", words, bits)).withColumn("n_chars", F.length("text").cast("long"))
    led = led.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half)))
    led = _with_parts(led.select(id_col, "n_chars", "edited", "parts", "next_parts"), "edited", words, bits, "edited_parts")
    return led.select(id_col, "n_chars", "edited", "parts", "edited_parts", likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("parts"), F.col("next_parts")).alias("near_next"))
