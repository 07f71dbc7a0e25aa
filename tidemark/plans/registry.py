"""Named queries over the driver's tables, each with the DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, read) -> DataFrame, where read(table) reads a table of the directory."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles that two engines add up in different orders agree once rounded."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


#: The day table of `events` (operators.folds.event_days).
DAY = """day AS (
  SELECT user_id AS subject_id, CAST(ts AS DATE) AS day,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(value) * 100.0) AS x, count(*) AS n_events,
    count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup,
    count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view,
    count(*) FILTER (event_type = 'click') AS n_click, count(*) >= 2 AS valid
  FROM events GROUP BY 1, 2)"""


def past(days: int, lag: int) -> str:
    return f"(PARTITION BY subject_id ORDER BY day RANGE BETWEEN INTERVAL {lag + days} DAY PRECEDING AND INTERVAL {lag + 1} DAY PRECEDING)"


#: The day table with z (28 days, lag 7, 7 values).
Z = f"""{DAY},
zref AS (SELECT *, list(x) FILTER (valid) OVER {past(28, 7)} AS l FROM day),
zmed AS (SELECT *, coalesce(len(l), 0) AS ref_n, list_aggregate(l, 'median') AS ref_median FROM zref),
zmad AS (SELECT *, list_aggregate(list_transform(l, lambda v: abs(v - ref_median)), 'median') AS ref_mad FROM zmed),
z AS (SELECT *, CASE WHEN valid AND ref_n >= 7 THEN (x - ref_median) / nullif(ref_mad * 1.4826, 0) END AS z FROM zmad)"""
