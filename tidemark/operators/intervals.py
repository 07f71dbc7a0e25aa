"""Interval joins. The subject is always an equi-key; long histories add a time bucket, so no subject is quadratic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(points: DataFrame, t: str, spans: DataFrame, start: str, end: str, width: float) -> tuple[DataFrame, DataFrame]:
    """Points with their bucket, spans with every bucket they touch (seconds, as double)."""
    p = points.withColumn("_bucket", F.floor(F.col(t) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p, s


def within_span(points: DataFrame, spans: DataFrame, t: str = "t", start: str = "start", end: str = "end", subject: str = "subject_id", out: str = "inside") -> DataFrame:
    """`points` with a flag: the subject's last span that starts at or before t has not ended by then (half-open).

    One union and one window instead of a join: the latest start and its end are carried forward to each point.
    """
    cols = points.columns
    p = points.select(*cols, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_end"))
    s = spans.select(*[F.col(subject).alias(c) if c == subject else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols], F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.col(end).cast("double").alias("_end"))
    w = Window.partitionBy(subject).orderBy("_t", "_kind", F.col("_end").asc_nulls_last())
    both = p.unionByName(s).withColumn("_last", F.last("_end", ignorenulls=True).over(w))
    return both.where("_kind = 1").select(*cols, F.coalesce(F.col("_t") < F.col("_last"), F.lit(False)).alias(out))


def label_by_overlap(windows: DataFrame, events: DataFrame, least: float = 0.5, width: float = 3600.0, subject: str = "subject_id", key: str = "window_id", t0: str = "t0", t1: str = "t1", event_key: str = "event_id") -> DataFrame:
    """`windows` with the event of the largest overlap (the first of equals), overlap and label.

    Labels: REPORTED_CALM for level 0, STRESS_EVENT for 1 and above, if it covers the share `least` of the window.
    """
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(t0) / width), F.floor(F.col(t1) / width))))
    e = events.select(subject, F.col(event_key).alias("_e"), F.col("start").alias("_s"), F.col("end").alias("_f"), F.col("level").alias("_level"))
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_f") / width))))
    met = w.join(e, [subject, "_b"]).where((F.col("_s") < F.col(t1)) & (F.col("_f") > F.col(t0)))
    overlap = F.least(F.col(t1), F.col("_f")) - F.greatest(F.col(t0), F.col("_s"))
    best = met.groupBy(key).agg(F.max(F.struct(overlap.alias("o"), (-F.col("_s")).alias("s"), (-F.col("_e")).alias("e"), F.col("_level").alias("level"))).alias("_best"))
    out = windows.join(best, key, "left")
    enough = F.col("_best.o") / F.greatest(F.col(t1) - F.col(t0), F.lit(1e-9)) >= least
    label = F.when(enough & (F.col("_best.level") == 0), "REPORTED_CALM").when(enough & (F.col("_best.level") >= 1), "STRESS_EVENT")
    return out.select(*windows.columns, F.when(enough, -F.col("_best.e")).alias(event_key), F.when(enough, F.col("_best.o")).alias("overlap"), label.alias("label"))


def count_overlaps(spans: DataFrame, events: DataFrame, width: float = 86400.0, subject: str = "subject_id", key: str = "session_id", event_key: str = "event_id") -> DataFrame:
    """`spans` with n_events, the number of events that overlap them."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    e = events.select(subject, F.col(event_key).alias("_e"), F.col("start").alias("_s"), F.col("end").alias("_f"))
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_f") / width))))
    met = s.join(e, [subject, "_b"]).where((F.col("_s") < F.col("t1")) & (F.col("_f") > F.col("t0")))
    # an event met in several buckets counts in the first that both touch
    met = met.where(F.col("_b") == F.floor(F.greatest(F.col("t0"), F.col("_s")) / width))
    return spans.join(met.groupBy(key).agg(F.count("*").alias("n_events")), key, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("bigint"))


def minutes_to_nearest(points: DataFrame, events: DataFrame, t: str = "t", subject: str = "subject_id", out: str = "minutes") -> DataFrame:
    """`points` with the minutes to the subject's nearest event interval: 0 inside, NULL without events.

    The latest end among the events begun by t and the next start after t decide; both are running extremes.
    """
    cols = points.columns
    p = points.select(*cols, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_f"))
    e = events.select(*[F.col(subject).alias(c) if c == subject else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols], F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_f"))
    w = Window.partitionBy(subject).orderBy("_t", "_kind")
    both = p.unionByName(e)
    both = both.withColumn("_before", F.max("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_after", F.min("_s").over(w.rowsBetween(0, Window.unboundedFollowing)))
    some = lambda d: F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
    gap = F.least(some(F.col("_t") - F.col("_before")), some(F.col("_after") - F.col("_t")))
    return both.where("_kind = 1").select(*cols, (gap / 60.0).alias(out))


def around_events(points: DataFrame, events: DataFrame, value: str, t: str = "t", reach: float = 300.0, min_n: int = 3, subject: str = "subject_id", event_key: str = "event_id") -> DataFrame:
    """-> (subject, event, n, median) of the points within `reach` seconds of each event's interval, from min_n on."""
    e = events.select(subject, event_key, (F.col("start") - reach).alias("_s"), (F.col("end") + reach).alias("_f"))
    p, e = _bucketed(points, t, e, "_s", "_f", 4 * reach)
    met = p.join(e, [subject, "_bucket"]).where(F.col(t).between(F.col("_s"), F.col("_f")))
    return met.groupBy(subject, event_key).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median")).where(F.col("n") >= min_n)


def last_within(anchors: DataFrame, others: DataFrame, days: int = 30, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """-> (subject, anchor, event_day): the other kind's last day within so many days up to each anchor, else the anchor.

    Running maximum over one sorted union, no join.
    """
    a = anchors.select(subject, F.col(day).alias("_d"), F.lit(1).alias("_kind")).distinct()
    o = others.select(subject, F.col(day).alias("_d"), F.lit(0).alias("_kind")).distinct()
    w = Window.partitionBy(subject).orderBy("_d", "_kind")
    both = a.unionByName(o).withColumn("_last", F.max(F.when(F.col("_kind") == 0, F.col("_d"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.when(F.datediff("_d", "_last") <= days, F.col("_last"))
    return both.where("_kind = 1").select(subject, F.col("_d").alias("anchor"), F.coalesce(near, F.col("_d")).alias("event_day"))
