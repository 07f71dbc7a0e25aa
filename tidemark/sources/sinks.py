"""Writers: checked prediction tables, window tables in two formats, ledgers that keep the last row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.facts import keep_last

#: Columns of a prediction table and keys of a results ledger.
PREDICTIONS = ["experiment", "model", "split", "feature_set", "fold", "sample_id", "subject_id", "true_label", "pred_label", "confidence"]
LEDGER_KEYS = ["experiment", "model", "split", "feature_set", "metric"]


def arranged(df: DataFrame, first: list[str], renames: dict[str, str] | None = None, rest: bool = True) -> DataFrame:
    """`df` renamed, with the columns `first` (those it has) in that order, then, unless `rest` is false, all others in theirs."""
    named = df.withColumnsRenamed(renames or {})
    head = [c for c in first if c in named.columns]
    return named.select(*head, *([c for c in named.columns if c not in head] if rest else []))


def write_predictions(df: DataFrame, path: str) -> None:
    """Write a prediction table; a missing column is an error before anything is written."""
    if missing := [c for c in PREDICTIONS if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    arranged(df, PREDICTIONS).write.mode("append").parquet(path)


def write_windows(df: DataFrame, path: str) -> None:
    """A window table as parquet and as CSV with a header, in sub-folders."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def upsert(spark: SparkSession, old: str | None, new: DataFrame, out: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an old table (or none) and new rows, written to `out`, another folder than `old`."""
    both = spark.read.parquet(old).unionByName(new, allowMissingColumns=True) if old else new
    keep_last(both, keys, order).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses more than `most` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line("-" for _ in rows.columns), *[line(r) for r in got]])
