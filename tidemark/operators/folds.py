"""Folds of raw rows into minutes, days and nights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(value: Column) -> Column:
    """A value of two decimals as a whole number: sums of it do not depend on their order."""
    return F.round(value * 100).cast("bigint")


def exact_mean(value: Column) -> Column:
    """Mean of values of two decimals, exact before its one division."""
    return F.sum(cents(value)).cast("double") / (F.count(value) * 100.0)


def local_day(ts: Column, zone: str) -> Column:
    """Calendar day in a zone of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def waking_day(ts: Column) -> Column:
    """Noon-to-noon day: a night belongs to the day on which it ends."""
    return F.to_date(ts + F.expr("INTERVAL 12 HOURS"))


def fold_days(windows: DataFrame, carried: str = "carried", min_windows: int = 10, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """Window verdicts -> (subject, day, n_windows, n_carried, carried_frac, valid); short days stay, not valid."""
    counted = windows.groupBy(subject, day).agg(F.count("*").alias("n_windows"), F.count_if(F.coalesce(F.col(carried), F.lit(False))).alias("n_carried"))
    return counted.withColumn("carried_frac", F.col("n_carried") / F.col("n_windows")).withColumn("valid", F.col("n_windows") >= min_windows)


def fold_nights(minutes: DataFrame, asleep: Column, subject: str = "subject_id", ts: str = "ts", hr: str = "hr") -> DataFrame:
    """Minute rows -> (subject, day, night_hr, night_min) over the minutes asleep with a positive heart rate, by waking day."""
    some = minutes.where(asleep & (F.col(hr) > 0))
    return some.groupBy(subject, waking_day(F.col(ts)).alias("day")).agg(exact_mean(F.col(hr)).alias("night_hr"), F.count("*").alias("night_min"))


def rollup_minutes(rows: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """-> (keys, minute, mean, total, highest, n)."""
    v = F.col(value)
    return rows.groupBy(*keys, F.date_trunc("minute", ts).alias("minute")).agg(
        exact_mean(v).alias("mean"), (F.sum(cents(v)) / 100.0).alias("total"), F.max(v).alias("highest"), F.count("*").alias("n")
    )


def event_days(events: DataFrame) -> DataFrame:
    """The driver's events as a day table: x is the daily mean value, with counts by type and a validity flag."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    days = events.groupBy(F.col("user_id").alias("subject_id"), F.to_date("ts").alias("day")).agg(
        exact_mean(F.col("value")).alias("x"), F.count("*").alias("n_events"), n("purchase").alias("n_purchase"), n("signup").alias("n_signup"), n("error").alias("n_error"), n("view").alias("n_view"), n("click").alias("n_click")
    )
    return days.withColumn("valid", F.col("n_events") >= 2)
