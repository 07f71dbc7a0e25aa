"""Day folds and personal baselines over `events`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import baselines, folds, service, windows
from tidemark.plans.registry import DAY, Z, past, query, rounded


def day_table(read):
    return folds.event_days(read("events"))


def z_table(read):
    return baselines.rolling_z(day_table(read), "x", 28, 7, 7)


@query("""SELECT user_id AS subject_id, CAST(ts AS DATE) AS day, count(*) AS n_windows, count(*) FILTER (value > 50) AS n_carried,
  round(count(*) FILTER (value > 50) / count(*), 6) AS carried_frac, count(*) >= 3 AS valid FROM events GROUP BY 1, 2""")
def day_fold(spark, read):
    e = read("events").select(F.col("user_id").alias("subject_id"), F.to_date("ts").alias("day"), (F.col("value") > 50).alias("carried"))
    return rounded(folds.fold_days(e, min_windows=3), "carried_frac")


@query("""SELECT user_id, date_trunc('minute', ts) AS minute, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0), 6) AS mean,
  round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0, 6) AS total, max(value) AS highest, count(*) AS n FROM events GROUP BY 1, 2""")
def minute_rollup(spark, read):
    return rounded(folds.rollup_minutes(read("events"), ["user_id"], "ts", "value"), "mean", "total")


@query("""SELECT CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def local_day_chicago(spark, read):
    return read("events").groupBy(folds.local_day(F.col("ts").cast("timestamp"), "America/Chicago").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT user_id AS subject_id, CAST(ts + INTERVAL 12 HOUR AS DATE) AS day,
  round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0), 6) AS night_hr, count(*) AS night_min
  FROM events WHERE event_type IN ('view', 'click') AND value > 0 GROUP BY 1, 2""")
def noon_shift_day(spark, read):
    e = read("events").withColumnsRenamed({"user_id": "subject_id", "value": "hr"})
    return rounded(folds.fold_nights(e, F.col("event_type").isin("view", "click")), "night_hr")


@query("""SELECT user_id AS subject_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  round(CAST(sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100.0, 6) AS view_value,
  max(CASE WHEN event_type = 'error' THEN value END) AS worst_error, bool_or(event_type = 'signup') AS any_signup FROM events GROUP BY 1, 2""")
def conditional_daily_sums(spark, read):
    kind = lambda k: F.col("event_type") == k
    out = read("events").groupBy(F.col("user_id").alias("subject_id"), F.to_date("ts").alias("day")).agg(
        F.count_if(kind("purchase")).alias("n_purchase"), (F.sum(F.when(kind("view"), folds.cents(F.col("value"))).otherwise(0)).cast("double") / 100.0).alias("view_value"),
        F.max(F.when(kind("error"), F.col("value"))).alias("worst_error"), F.bool_or(kind("signup")).alias("any_signup"),
    )
    return rounded(out, "view_value")


@query(f"WITH {Z} SELECT subject_id, day, round(x, 6) AS x, valid, round(z, 6) AS z FROM z")
def rolling_z(spark, read):
    return rounded(z_table(read), "x", "z").select("subject_id", "day", "x", "valid", "z")


@query(f"""WITH {DAY}, q AS (SELECT *, list(x) OVER {past(28, 0)} AS l FROM day)
SELECT subject_id, day, CASE WHEN len(l) >= 10 THEN round(list_aggregate(l, 'quantile_cont', 0.9), 6) END AS q FROM q""")
def rolling_quantile(spark, read):
    return rounded(baselines.rolling_quantile(day_table(read), "x", 0.9, 28, 0, 10), "q").select("subject_id", "day", "q")


@query(f"""WITH {Z} SELECT subject_id, day, CAST(ref_n AS BIGINT) AS ref_n, round(ref_median, 6) AS ref_median, round(ref_mad, 6) AS ref_mad,
  CASE WHEN valid AND ref_n >= 3 THEN round((x - ref_median) / CASE WHEN ref_mad * 1.4826 > 0 THEN ref_mad * 1.4826 ELSE 1.0 END, 6) END AS z FROM zmad""")
def rolling_ref_floor(spark, read):
    ref = baselines.rolling_reference(day_table(read), "x", 28, 7)
    z = baselines.rolling_z(ref.select("subject_id", "day", "x", "valid"), "x", 28, 7, 3, mad_floor=1.0).select("subject_id", "day", "z")
    out = ref.join(z, ["subject_id", "day"]).select("subject_id", "day", "ref_n", "ref_median", "ref_mad", "z")
    return rounded(out, "ref_median", "ref_mad", "z")


@query(f"""WITH {DAY}, n AS (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY subject_id) AS n_valid FROM day)
SELECT subject_id, day, n_valid, CASE WHEN n_valid < 2 THEN 'early' WHEN n_valid < 21 THEN 'adapting' ELSE 'personal' END AS baseline_mode FROM n""")
def baseline_mode_ladder(spark, read):
    return baselines.mode_ladder(day_table(read)).select("subject_id", "day", "n_valid", "baseline_mode")


REF = f"""{DAY}, cut AS (SELECT *, quantile_cont(n_events, 0.5) OVER (PARTITION BY subject_id) AS c FROM day),
picked AS (SELECT *, count(*) FILTER (n_events <= c) OVER (PARTITION BY subject_id) AS k FROM cut),
ref AS (SELECT *, n_events <= c OR k < 3 AS is_ref FROM picked)"""


def ref_table(read):
    return baselines.reference_rows(day_table(read), "low_activity", activity="n_events")


@query(f"WITH {REF} SELECT subject_id, day, n_events, is_ref FROM ref")
def low_activity_mask(spark, read):
    return ref_table(read).select("subject_id", "day", "n_events", "is_ref")


@query("""WITH s AS (SELECT event_id, user_id AS subject_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS BIGINT) AS session, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY subject_id, session ORDER BY ts) AS r, count(*) OVER (PARTITION BY subject_id, session) AS c FROM s),
p AS (SELECT *, r <= greatest(5, floor(c * 0.4)) AS p FROM n)
SELECT event_id, subject_id, session, p OR count(*) FILTER (p) OVER (PARTITION BY subject_id, session) < 5 AS is_ref FROM p""")
def session_scope_temporal_mask(spark, read):
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    e = read("events").select("event_id", F.col("user_id").alias("subject_id"), week.alias("session"), "ts")
    out = baselines.reference_rows(e, "temporal", time="ts", share=0.4, min_n=5, keys=("subject_id", "session"))
    return out.select("event_id", "subject_id", "session", "is_ref")


@query(f"WITH {DAY} SELECT subject_id, day, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS score FROM day")
def scores_global_z(spark, read):
    return rounded(baselines.global_z(day_table(read), "x"), "score").select("subject_id", "day", "score")


@query(f"WITH {DAY} SELECT subject_id, day, round(((rank() OVER (ORDER BY x) - 1) / count(*) OVER () - 0.5) * 4.0, 6) AS score FROM day")
def scores_global_pct(spark, read):
    return rounded(baselines.global_percentile(day_table(read), "x"), "score").select("subject_id", "day", "score")


@query(f"""WITH {REF}, s AS (SELECT *, count(*) FILTER (is_ref) OVER w AS k, avg(CASE WHEN is_ref THEN x END) OVER w AS m, stddev_pop(CASE WHEN is_ref THEN x END) OVER w AS sd,
  avg(x) OVER w AS ma, stddev_pop(x) OVER w AS sda FROM ref WINDOW w AS (PARTITION BY subject_id))
SELECT subject_id, day, round(CASE WHEN k < 3 THEN (x - ma) / coalesce(nullif(sda, 0), 1) ELSE (x - m) / coalesce(nullif(sd, 0), 1) END, 6) AS score FROM s""")
def scores_subject_z(spark, read):
    return rounded(baselines.subject_z(ref_table(read), "x"), "score").select("subject_id", "day", "score")


@query(f"""WITH {REF}, u AS (SELECT *, is_ref OR count(*) FILTER (is_ref) OVER (PARTITION BY subject_id) < 3 AS use FROM ref)
SELECT a.subject_id, a.day, round((count(*) FILTER (b.x < a.x) / count(*) - 0.5) * 4.0, 6) AS score FROM u a JOIN u b ON a.subject_id = b.subject_id AND b.use GROUP BY a.subject_id, a.day, a.x""")
def scores_subject_pct(spark, read):
    return rounded(baselines.subject_percentile(ref_table(read), "x"), "score").select("subject_id", "day", "score")


ROBUST = f"""{REF}, r AS (SELECT *, list(x) FILTER (is_ref) OVER w AS l, stddev_pop(CASE WHEN is_ref THEN x END) OVER w AS sd FROM ref WINDOW w AS (PARTITION BY subject_id)),
m AS (SELECT *, list_aggregate(l, 'median') AS med FROM r),
d AS (SELECT *, list_aggregate(list_transform(l, lambda v: abs(v - med)), 'median') * 1.4826 AS mad FROM m),
rz AS (SELECT *, CASE WHEN len(l) >= 3 THEN (x - med) / coalesce(CASE WHEN mad > 0 THEN mad END, nullif(sd, 0), 1.0) END AS z_x FROM d)"""


@query(f"WITH {ROBUST} SELECT subject_id, day, round(z_x, 6) AS z_x FROM rz")
def robust_z_group(spark, read):
    return rounded(baselines.robust_z(ref_table(read), ["x"], keys=("subject_id",)), "z_x").select("subject_id", "day", "z_x")


KINDS = ["view", "click", "error", "purchase"]
SIGNS = {"view": 1, "click": -1, "error": 1, "purchase": 1}


def channels(read):
    """One row per subject and day: each channel's daily mean value, and z of each against all the subject's days."""
    e = read("events").where(F.col("event_type").isin(KINDS))
    mean = folds.exact_mean(F.col("value"))
    wide = e.groupBy(F.col("user_id").alias("subject_id"), F.to_date("ts").alias("day")).pivot("event_type", KINDS).agg(mean)
    return baselines.robust_z(wide.withColumn("is_ref", F.lit(True)), KINDS, keys=("subject_id",))


def _channel_sql(k: str) -> str:
    mean = f"CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = '{k}') AS DOUBLE) / nullif(count(*) FILTER (event_type = '{k}') * 100.0, 0)"
    return f"{mean} AS {k}"


CHANNELS = f"""wide AS (SELECT user_id AS subject_id, CAST(ts AS DATE) AS day, {", ".join(_channel_sql(k) for k in KINDS)} FROM events
  WHERE event_type IN ({", ".join(f"'{k}'" for k in KINDS)}) GROUP BY 1, 2),
lists AS (SELECT *, {", ".join(f"list({k}) FILTER ({k} IS NOT NULL) OVER w AS l_{k}, stddev_pop({k}) OVER w AS sd_{k}" for k in KINDS)} FROM wide WINDOW w AS (PARTITION BY subject_id)),
meds AS (SELECT *, {", ".join(f"list_aggregate(l_{k}, 'median') AS m_{k}" for k in KINDS)} FROM lists),
mads AS (SELECT *, {", ".join(f"list_aggregate(list_transform(l_{k}, lambda v: abs(v - m_{k})), 'median') * 1.4826 AS d_{k}" for k in KINDS)} FROM meds),
zs AS (SELECT subject_id, day, {", ".join(f"CASE WHEN len(l_{k}) >= 3 THEN ({k} - m_{k}) / coalesce(CASE WHEN d_{k} > 0 THEN d_{k} END, nullif(sd_{k}, 0), 1.0) END AS z_{k}" for k in KINDS)} FROM mads)"""


@query(f"""WITH {CHANNELS} SELECT subject_id, day, round(list_aggregate(list_filter([{", ".join(f"CASE WHEN z_{k} IS NOT NULL THEN greatest(z_{k} * {s}, 0) END" for k, s in SIGNS.items())}], lambda v: v IS NOT NULL), 'avg'), 6) AS deviation FROM zs""")
def deviation_signed(spark, read):
    return rounded(baselines.deviation(channels(read), SIGNS), "deviation").select("subject_id", "day", "deviation")


@query(f"""WITH {CHANNELS} SELECT subject_id, day, round(greatest({", ".join(f"abs(z_{k})" for k in KINDS)}), 6) AS deviation FROM zs""")
def deviation_max(spark, read):
    return rounded(baselines.deviation(channels(read), SIGNS, "max"), "deviation").select("subject_id", "day", "deviation")


@query(f"""WITH {CHANNELS} SELECT subject_id, day, round((abs(z_view) * 2.0 + abs(z_click) + abs(z_error) + abs(z_purchase)) / 5.0, 6) AS deviation FROM zs""")
def deviation_weighted(spark, read):
    return rounded(baselines.deviation(channels(read), SIGNS, "abs", {"view": 2.0}), "deviation").select("subject_id", "day", "deviation")


@query("""WITH l AS (SELECT event_id, user_id AS subject_id, value, list(value) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS l FROM events)
SELECT event_id, CASE WHEN len(l) >= 3 THEN round(list_aggregate(l, 'median'), 6) END AS base FROM l""")
def service_baseline_14d(spark, read):
    e = read("events").withColumnRenamed("user_id", "subject_id")
    return rounded(service.recent_baseline(e, "value", usable=F.col("event_type") != "error"), "base").select("event_id", "base")


@query(f"""WITH r AS (SELECT user_id AS subject_id, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS routine, CAST(ts AS DATE) AS day,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3),
l AS (SELECT *, list(v) FILTER (day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14') OVER (PARTITION BY subject_id, routine ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS p,
  list(v) OVER (PARTITION BY subject_id, routine ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS w FROM r),
f AS (SELECT *, CASE WHEN len(p) >= 4 THEN p ELSE w END AS l FROM l),
m AS (SELECT *, list_aggregate(l, 'median') AS base FROM f),
s AS (SELECT *, greatest(list_aggregate(list_transform(l, lambda x: abs(x - base)), 'median') * 1.4826, 1.0) AS spread, coalesce(len(l), 0) >= 4 AS ready FROM m)
SELECT subject_id, routine, day, round(base, 6) AS base, CASE WHEN NOT (n >= 1 AND v < 150) THEN 'low' WHEN NOT ready THEN 'building' WHEN abs(v - base) >= 2.5 * spread THEN 'diff' ELSE 'same' END AS verdict FROM s""")
def routine_baseline_judge(spark, read):
    r = read("events").groupBy(F.col("user_id").alias("subject_id"), F.when(F.hour("ts") < 12, "morning").otherwise("evening").alias("routine"), F.to_date("ts").alias("day")).agg(folds.exact_mean(F.col("value")).alias("v"), F.count("*").alias("n"))
    phase = service.phase_of(F.col("day"), F.lit("2024-01-15").cast("date"), F.lit("2024-01-19").cast("date"))
    out = service.routine_baseline(r, "v", phase == "prep")
    verdict = service.judge(F.col("v"), F.col("base"), F.col("spread"), F.col("ready"), (F.col("n") >= 1) & (F.col("v") < 150))
    return rounded(out.withColumn("verdict", verdict), "base").select("subject_id", "routine", "day", "base", "verdict")


@query("""WITH p AS (SELECT event_id, user_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l FROM events WHERE event_type <> 'error'),
b AS (SELECT *, CASE WHEN len(l) >= 5 THEN list_aggregate(l, 'median') END AS base FROM p),
s AS (SELECT *, CASE WHEN len(l) >= 5 THEN list_aggregate(list_transform(l, lambda v: abs(v - base)), 'median') END AS spread FROM b)
SELECT event_id, round(base, 6) AS base, round(spread, 6) AS spread, CASE WHEN base IS NULL THEN 'unknown' WHEN value - base >= greatest(5.0, 2 * spread) THEN 'high' WHEN value - base <= -greatest(5.0, 2 * spread) THEN 'low' ELSE 'same' END AS level FROM s""")
def device_baseline_last30(spark, read):
    out = baselines.device_baseline(read("events"), "value", F.col("event_type") != "error", ["ts", "event_id"], subject="user_id")
    return rounded(out, "base", "spread").select("event_id", "base", "spread", "level")


@query(f"""WITH {DAY} SELECT subject_id, day, coalesce(datediff('day', lag(day) OVER w, day) = 1 AND lag(n_purchase) OVER w > 0, false) AS exercise FROM day WINDOW w AS (PARTITION BY subject_id ORDER BY day)""")
def previous_day_cause(spark, read):
    d = day_table(read)
    return d.select("subject_id", "day", baselines.previous_day_flag(d, F.col("n_purchase") > 0).alias("exercise"))


@query(f"""WITH {DAY} SELECT subject_id, day, round(avg(x) OVER w, 6) AS x3, CAST(sum(n_error) OVER w AS BIGINT) AS error3 FROM day WINDOW w AS (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def trailing3(spark, read):
    w = Window.partitionBy("subject_id").orderBy("day").rowsBetween(-2, 0)
    return rounded(day_table(read).select("subject_id", "day", F.avg("x").over(w).alias("x3"), F.sum("n_error").over(w).alias("error3")), "x3")


@query(f"""WITH {DAY}, s AS (SELECT subject_id, min(day) AS a, max(day) AS b FROM day GROUP BY 1),
g AS (SELECT s.subject_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
j AS (SELECT g.subject_id, g.day, n_purchase FROM g LEFT JOIN day USING (subject_id, day))
SELECT subject_id, day, coalesce(count(n_purchase) OVER w = 3 AND sum(n_purchase) OVER w = 0, false) AS resting FROM j WINDOW w AS (PARTITION BY subject_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)""")
def resting_flag(spark, read):
    grid = windows.densified(day_table(read)).withColumn("number", F.unix_date("day"))
    return grid.select("subject_id", "day", F.coalesce(windows.resting(grid, "n_purchase", 3), F.lit(False)).alias("resting"))


@query(f"""WITH {DAY}, g AS (SELECT s.subject_id, CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT subject_id FROM day) s)
SELECT g.subject_id, g.day, count(x) AS n, round(median(x), 6) AS median FROM g LEFT JOIN day USING (subject_id, day) GROUP BY 1, 2""")
def week_grid(spark, read):
    return rounded(service.week_grid(day_table(read), F.lit("2024-01-30").cast("date"), "x"), "median")


@query(f"""WITH {DAY} SELECT subject_id, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS high FROM day GROUP BY 1""")
def describe_subjects(spark, read):
    q = lambda p: F.percentile("x", F.lit(p))
    out = day_table(read).groupBy("subject_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("low"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("x").alias("high"))
    return rounded(out, "mean", "low", "q25", "q50", "q75", "high")


