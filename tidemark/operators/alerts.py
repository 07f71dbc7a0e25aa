"""Alerts after K unresolved days, their evaluation against events, and chance levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375


def alerts(days: DataFrame, limit: Column | float = 0.5, k: Column | int = 3, max_gap: int = 2, refractory: int = 7, hold: str | None = "held", keys: tuple[str, ...] = ("subject_id",), day: str = "day") -> DataFrame:
    """`days` with unresolved, run_len and alert.

    Days that are not valid or held neither break nor extend a run; a calendar gap above max_gap breaks it. Runs are
    islands between resets (windows over one sort); the refractory choice is greedy, so each key's days (a row a day) are
    gathered, in the same partitioning, and its candidate days are folded once.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    k = k if isinstance(k, Column) else F.lit(k)
    w = Window.partitionBy(*keys).orderBy(day)
    valid = F.coalesce(F.col("valid"), F.lit(False))
    judged = valid & ~F.coalesce(F.col(hold), F.lit(False)) if hold else valid
    gap = F.datediff(F.col(day), F.lag(day).over(w))
    out = days.withColumn("unresolved", valid & F.coalesce(F.col("carried_frac") >= limit, F.lit(False))).withColumn("_judged", judged)
    reset = F.coalesce(gap > max_gap, F.lit(False)) | (F.col("_judged") & ~F.col("unresolved"))
    out = out.withColumn("_island", F.sum(reset.cast("int")).over(w))
    run = F.sum((F.col("_judged") & F.col("unresolved")).cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(day))
    out = out.withColumn("run_len", F.when(F.col("_judged") & F.col("unresolved"), run).otherwise(0).cast("bigint"))
    out = out.withColumn("_candidate", F.col("_judged") & (F.col("run_len") >= k)).drop("_judged", "_island")
    # the greedy choice is folded at each key's last row, over its candidate days alone, and shown to its other rows: windows
    # over the one sort that is there
    none, every = F.array().cast("array<int>"), Window.partitionBy(*keys)
    step = lambda acc, d: F.when((F.size(acc) == 0) | (d - F.coalesce(F.get(acc, F.size(acc) - 1), d) >= refractory), F.concat(acc, F.array(d))).otherwise(acc)
    out = out.withColumn("_days", F.collect_list(F.when(F.col("_candidate"), F.unix_date(day))).over(every)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    out = out.withColumn("_fired", F.max(F.when(F.col("_last"), F.aggregate(F.array_sort("_days"), none, step))).over(every))
    return out.withColumn("alert", F.col("_candidate") & F.array_contains("_fired", F.unix_date(day))).drop("_candidate", "_days", "_last", "_fired")


def evaluate(days: DataFrame, events: DataFrame, before: int = 1, after: int = 1, keys: tuple[str, ...] = (), subject: str = "subject_id", day: str = "day") -> DataFrame:
    """-> keys, observed_days, n_alerts, alerts_per_person_month, n_events, n_detected, detection_rate, n_matched, alert_precision.

    An event in (subject, day) is detected by an alert in [day - before, day + after]. `keys` (say k of a sweep) are
    evaluated side by side; events serve them all. Matching is an equi-join on exploded day offsets, so its size is
    the alerts' number times the window's.
    """
    valid = days.where(F.coalesce(F.col("valid"), F.lit(False)))
    totals = valid.groupBy(*keys).agg(F.count("*").alias("observed_days"), F.count_if("alert").alias("n_alerts"))
    fired = valid.where("alert").select(*keys, F.col(subject).alias("_s"), F.col(day).alias("_a"))
    ev = events.select(F.col(subject).alias("_s"), F.col(day).alias("_e")).distinct()
    reach = fired.withColumn("_e", F.explode(F.sequence(F.date_sub("_a", after), F.date_add("_a", before))))
    met = reach.join(ev, ["_s", "_e"])
    hits = met.groupBy(*keys).agg(F.countDistinct("_s", "_e").alias("n_detected"), F.countDistinct("_s", "_a").alias("n_matched"))
    n_events = ev.agg(F.count("*").alias("n_events"))  # one row
    out = totals.join(hits, list(keys), "left") if keys else totals.join(hits, F.lit(True), "left")
    out = out.join(F.broadcast(n_events), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    return out.select(
        *keys, "observed_days", "n_alerts", (F.col("n_alerts") / F.nullif(F.col("observed_days") / F.lit(DAYS_PER_MONTH), F.lit(0.0))).alias("alerts_per_person_month"), "n_events", zero(F.col("n_detected")).alias("n_detected"),
        share(zero(F.col("n_detected")), F.col("n_events")).alias("detection_rate"), zero(F.col("n_matched")).alias("n_matched"), share(zero(F.col("n_matched")), F.col("n_alerts")).alias("alert_precision"),
    )


def sweep(days: DataFrame, events: DataFrame, ks: list[int], before: int = 1, after: int = 1, **options) -> DataFrame:
    """`evaluate` for each k, as one plan: rows are repeated per k inside their tasks."""
    each = days.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
    return evaluate(alerts(each, k=F.col("k"), keys=("subject_id", "k"), **options), events, before, after, ("k",))


def _drawn(frames: Iterator[pd.DataFrame], n_perm: int, seed: int, before: int, after: int, block: int = 250) -> Iterator[pd.DataFrame]:
    """Subjects as (key, days, events, n_alerts), day numbers in arrays -> (perm, n_detected, n_matched) summed over a task's subjects."""
    detected, matched = np.zeros(n_perm, np.int64), np.zeros(n_perm, np.int64)
    for frame in frames:
        for key, days, events, n in frame.itertuples(index=False):
            days, events = np.sort(np.asarray(days, np.int64)), np.asarray(events if events is not None else [], np.int64)
            hit = (events >= days[:, None] - after) & (events <= days[:, None] + before)  # days x events
            draw = np.random.default_rng([seed, int(key) & 0xFFFFFFFF, int(key) >> 32 & 0xFFFFFFFF])
            for a in range(0, n_perm, block):
                order = draw.random((min(block, n_perm - a), len(days)))
                chosen = np.zeros(order.shape, np.float32)
                np.put_along_axis(chosen, np.argpartition(order, n - 1, axis=1)[:, :n], 1.0, axis=1)
                detected[a : a + block] += ((chosen @ hit.astype(np.float32)) > 0).sum(1)
                matched[a : a + block] += (chosen @ hit.any(1).astype(np.float32)).astype(np.int64)
    yield pd.DataFrame({"perm": np.arange(n_perm), "n_detected": detected, "n_matched": matched})


def chance_level(days: DataFrame, events: DataFrame, n_perm: int = 2000, seed: int = 0, before: int = 1, after: int = 1, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """One row (perm, the columns of `evaluate`) a permutation: each subject's alerts on as many of its valid days, drawn anew.

    A subject's days and events are one row of day numbers, and all its permutations are drawn inside one task by a generator
    seeded with the subject, whatever its task; only counts for each permutation leave it, summed over the task's subjects.
    """
    valid = days.where(F.coalesce(F.col("valid"), F.lit(False)))
    ev = events.select(F.col(subject).alias(subject), F.col(day).alias("_e")).distinct()
    per = valid.groupBy(subject).agg(F.collect_list(F.unix_date(day)).alias("days"), F.count_if("alert").cast("int").alias("n"))
    totals = per.agg(F.sum(F.size("days")).cast("bigint").alias("observed_days"), F.sum("n").cast("bigint").alias("n_alerts"))
    totals = totals.join(F.broadcast(ev.agg(F.count("*").alias("n_events"))), F.lit(True))  # one row each
    theirs = ev.groupBy(subject).agg(F.collect_list(F.unix_date("_e")).alias("events"))
    rows = per.where("n > 0").join(theirs, subject, "left").select(F.xxhash64(subject).alias("key"), "days", "events", "n")
    counts = rows.mapInPandas(lambda f: _drawn(f, n_perm, seed, before, after), "perm bigint, n_detected bigint, n_matched bigint")
    whole = rows.sparkSession.range(n_perm).select(F.col("id").alias("perm"), F.lit(0).cast("bigint").alias("n_detected"), F.lit(0).cast("bigint").alias("n_matched"))
    sums = counts.unionByName(whole).groupBy("perm").agg(F.sum("n_detected").alias("n_detected"), F.sum("n_matched").alias("n_matched"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return sums.join(F.broadcast(totals), F.lit(True)).select(
        "perm", "observed_days", "n_alerts", (F.col("n_alerts") / F.nullif(F.col("observed_days") / F.lit(DAYS_PER_MONTH), F.lit(0.0))).alias("alerts_per_person_month"), "n_events", "n_detected",
        share("n_detected", "n_events").alias("detection_rate"), "n_matched", share("n_matched", "n_alerts").alias("alert_precision"),
    )


def chance_summary(days: DataFrame, events: DataFrame, before: int = 1, after: int = 1, **options) -> DataFrame:
    """-> one row: the observed detection_rate and alert_precision, their means by chance, and the shares of permutations that reach them."""
    seen = evaluate(days, events, before, after).select("detection_rate", "alert_precision")
    by_chance = chance_level(days, events, before=before, after=after, **options).select(F.col("detection_rate").alias("_d"), F.col("alert_precision").alias("_p"))
    reached = lambda c, o: F.avg(F.coalesce(F.col(c) >= F.col(o), F.lit(False)).cast("double"))
    return by_chance.join(F.broadcast(seen), F.lit(True)).agg(
        F.first("detection_rate").alias("detection_rate"), F.first("alert_precision").alias("alert_precision"), F.avg("_d").alias("chance_detection_rate"), F.avg("_p").alias("chance_alert_precision"),
        reached("_d", "detection_rate").alias("p_detection"), reached("_p", "alert_precision").alias("p_precision"),
    )


def matched(days: DataFrame, score: str, cuts: list[float], other: DataFrame, k: int = 1, limit: float = 0.5, hold: str | None = None, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """-> one row (cut, n_alerts, target): the cut of `score` whose number of alerts is nearest to that of another arm, the least of equals.

    `other` is the arm to match, with its alerts marked. All cuts are judged in one plan; one row a cut is gathered.
    """
    grid = days.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in sorted(cuts)])))
    grid = grid.withColumn("carried_frac", F.coalesce(F.col("valid") & (F.col(score) >= F.col("cut")), F.lit(False)).cast("double"))
    n = alerts(grid, limit, k, hold=hold, keys=(*keys, "cut")).groupBy("cut").agg(F.count_if("alert").alias("n"))
    both = n.unionByName(other.agg(F.lit(None).cast("double").alias("cut"), F.count_if("alert").alias("n")))
    rows = both.agg(F.max(F.when(F.col("cut").isNull(), F.col("n"))).alias("target"), F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("cut", "n"))).alias("_cuts"))
    best = F.array_min(F.transform("_cuts", lambda c: F.struct(F.abs(c["n"] - F.col("target")).alias("gap"), c["cut"].alias("cut"), c["n"].alias("n"))))
    return rows.select(best["cut"].alias("cut"), best["n"].alias("n_alerts"), "target")
