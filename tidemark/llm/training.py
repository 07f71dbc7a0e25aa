"""A bounded, reproducible sample of labelled documents for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled documents that are not held out: those with the least hash of the id.

    Rows without a label are skipped; of repeated labels of one id the largest counts, of rows that share an id the one whose
    text has the least hash.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id")
    first = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", "_label")).alias("_row")
    return joined.groupBy("_id").agg(first).select("_id", "_row._text", "_row._label")
