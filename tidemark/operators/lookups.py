"""Lookups in small fixed tables, and rows brought into another table's order by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_up(key: Column, table: dict, default=None) -> Column:
    """The value of a fixed dict, or the default. The dict travels within the expression: it is a parameter, not data."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def fixed_split(subject: Column, splits: dict[str, tuple]) -> Column:
    """The split that lists the subject; a subject in none of them is an error."""
    table = {member: name for name, members in splits.items() for member in members}
    unknown = F.raise_error(F.concat(F.lit("in no split: "), F.coalesce(subject.cast("string"), F.lit("null"))))
    return F.coalesce(looked_up(subject, table), unknown.cast("string"))


def aligned(predictions: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Each prediction with the features of its key, NULL where there are none: by key, as rows have no position.

    A key that stands twice among the features is an error of the input; its rows would be multiplied.
    """
    return predictions.join(features, key, "left")


def same_or_both_null(left: DataFrame, right: DataFrame, key: str, out: str) -> DataFrame:
    """`left` with `out`, the rows of `right` that have its key; an unknown key meets unknown keys. One shuffle on the key."""
    counts = right.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(out))
    return left.join(counts, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))
