"""Scan judgement, schedules, reports, votes and joins that the other plans leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import folds, scans
from tidemark.plans.registry import DAY, query, rounded
from tidemark.plans.time_queries import EVENTS, points

SAMPLES = f"""{EVENTS}, sm AS (SELECT subject_id, t / 86400.0 AS t, value * 2.0 AS brightness, value / 10.0 AS x, (event_id % 10) / 10.0 AS y, 100.0 AS width, CASE WHEN event_type = 'click' THEN 0.9 WHEN event_type = 'view' THEN 0.4 ELSE 0.1 END AS blink, CASE WHEN event_type = 'error' THEN 0.7 ELSE 0.1 END AS mouth FROM p)"""


def samples(read):
    kind = F.col("event_type")
    blink = F.when(kind == "click", 0.9).when(kind == "view", 0.4).otherwise(0.1)
    return points(read).select(
        "subject_id", (F.col("t") / 86400.0).alias("t"), (F.col("value") * 2.0).alias("brightness"), (F.col("value") / 10.0).alias("x"), ((F.col("event_id") % 10) / 10.0).alias("y"), F.lit(100.0).alias("width"), blink.alias("blink"), F.when(kind == "error", 0.7).otherwise(0.1).alias("mouth"),
    )


@query(f"""WITH {SAMPLES}, g AS (SELECT *, t - lag(t) OVER w AS gap, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) < 5.0, true) AS still FROM sm WINDOW w AS (PARTITION BY subject_id ORDER BY t)),
a AS (SELECT subject_id, count(*) AS n, avg(CAST(brightness BETWEEN 55 AND 225 AS INT)) AS br, avg(CAST(still AS INT)) AS st, avg(CAST(blink > 0.5 OR mouth > 0.5 AS INT)) AS bl, sum(CASE WHEN gap <= 1.0 THEN gap ELSE 0 END) / nullif(max(t) - min(t), 0) AS cov, max(gap) AS mg FROM g GROUP BY 1)
SELECT subject_id, n, round(br, 6) AS bright_share, round(st, 6) AS still_share, round(bl, 6) AS blink_share, CASE WHEN n < 40 THEN CASE WHEN coalesce(cov >= 0.85 AND mg <= 1.5, true) THEN 'short' ELSE 'coverage' END WHEN br < 0.9 THEN 'brightness' WHEN st < 0.85 THEN 'motion' WHEN bl >= 0.3 THEN 'blink' WHEN NOT coalesce(cov >= 0.85 AND mg <= 1.5, true) THEN 'coverage' ELSE 'snr' END AS reason FROM a""")
def quality_gates(spark, read):
    out = scans.quality_gates(samples(read), ["subject_id"], least=40, hole=1.0)
    return rounded(out.select("subject_id", "n", "bright_share", "still_share", "blink_share", "reason"), "bright_share", "still_share", "blink_share")



@query(f"""WITH {EVENTS}, f AS (SELECT subject_id, count(*) AS n FROM p GROUP BY 1), g AS (SELECT *, n % 7 - 4.0 AS snr, n % 4 AS agree, (n % 10) / 1000.0 AS ma, (n % 5) / 10.0 AS mf, (n % 11) / 10.0 AS lr, (n % 3) / 1000.0 AS la FROM f)
SELECT subject_id, n, CASE WHEN n < 5 THEN 'short' WHEN (ma >= 0.005 AND mf >= 0.2) OR (la >= 0.0003 AND lr >= 0.95) THEN 'interference' WHEN snr < -3 THEN 'snr' WHEN agree < 2 THEN 'roi' END AS reason,
  NOT (n < 5 OR (ma >= 0.005 AND mf >= 0.2) OR (la >= 0.0003 AND lr >= 0.95) OR snr < -3 OR agree < 2) AS passed FROM g""")
def pulse_gates(spark, read):
    """The gates that judge the pulse, over frames that pass all others."""
    s = points(read).select("subject_id", F.col("event_id").cast("double").alias("t"), *[F.lit(v).alias(c) for c, v in (("brightness", 120.0), ("x", 50.0), ("y", 50.0), ("width", 100.0), ("blink", 0.1), ("mouth", 0.1))])
    n = F.col("n")
    figures = s.groupBy("subject_id").agg(F.count("*").alias("n")).select(
        "subject_id", (n % 7 - 4.0).alias("snr"), (n % 4).cast("int").alias("agree"), (n % 10 / 1000.0).alias("motion_amp"), (n % 5 / 10.0).alias("motion_frac"), (n % 11 / 10.0).alias("light_ratio"), (n % 3 / 1000.0).alias("light_amp")
    )
    # frames a tick apart, so that coverage is whole
    w = Window.partitionBy("subject_id").orderBy("t")
    even = s.withColumn("t", F.row_number().over(w) / 30.0)
    return scans.quality_gates(even, ["subject_id"], figures, least=5).select("subject_id", "n", "reason", "passed")


@query(f"""WITH {EVENTS}, s AS (SELECT subject_id, min(t) / 3600.0 AS t0, max(t) / 3600.0 AS t1 FROM p GROUP BY 1), n AS (SELECT *, t1 - t0 - 15 AS tail, CAST(floor((t1 - t0 - 15 + 1e-6) / 5) AS INT) AS n FROM s WHERE t1 - t0 >= 20)
SELECT subject_id, round(unnest(list_concat(list_transform(range(n + 1), lambda k: k * 5.0), CASE WHEN tail - n * 5.0 > 0.5 THEN [tail] ELSE [] END)), 6) AS start FROM n""")
def scan_windows(spark, read):
    """Windows of 15 a step of 5 apart and one at the end, over each subject's hours."""
    spans = points(read).groupBy("subject_id").agg((F.min("t") / 3600.0).alias("t0"), (F.max("t") / 3600.0).alias("t1"))
    return rounded(scans.lay_windows(spans).select("subject_id", "start"), "start")


@query(f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t) AS i, count(*) OVER (PARTITION BY subject_id) AS n, coalesce(t - lag(t) OVER (PARTITION BY subject_id ORDER BY t), 0.0) AS dt FROM sm),
f AS (SELECT subject_id, 1 AS i, n, blink >= 0.5 AS shut, CAST(blink >= 0.5 AS INT) AS blinks FROM o WHERE i = 1 UNION ALL
  SELECT o.subject_id, o.i, o.n, CASE WHEN f.shut AND NOT o.dt > 1.0 THEN o.blink >= 0.35 ELSE o.blink >= 0.5 END, f.blinks + CAST(NOT (f.shut AND NOT o.dt > 1.0) AND o.blink >= 0.5 AS INT) FROM f JOIN o ON o.subject_id = f.subject_id AND o.i = f.i + 1),
s AS (SELECT subject_id, sum(CASE WHEN dt > 1.0 THEN 0 ELSE dt END) AS seconds, sum(CASE WHEN dt > 1.0 OR blink < 0.8 THEN 0 ELSE dt END) AS closed FROM o GROUP BY 1)
SELECT f.subject_id, round(seconds, 6) AS seconds, CAST(blinks AS BIGINT) AS blinks, round(closed / nullif(seconds, 0), 6) AS closed_share FROM f JOIN s USING (subject_id) WHERE i = n AND n >= 2""")
def face_state(spark, read):
    return rounded(scans.face_state(samples(read), ["subject_id"], hole=1.0).drop("yawns"), "seconds", "closed_share")


@query(f"""WITH {SAMPLES}, l AS (SELECT subject_id, list_sort(list(x / width)) AS xs, list_sort(list(y / width)) AS ys FROM sm GROUP BY 1), c AS (SELECT subject_id, xs[len(xs) // 2 + 1] AS cx, ys[len(ys) // 2 + 1] AS cy FROM l),
d AS (SELECT subject_id, list_sort(list(sqrt((x / width - cx) ** 2 + (y / width - cy) ** 2))) AS d FROM sm JOIN c USING (subject_id) GROUP BY 1) SELECT subject_id, round(d[len(d) // 2 + 1] * 100, 6) AS move FROM d""")
def head_movement(spark, read):
    return rounded(scans.head_movement(samples(read), ["subject_id"]), "move")


@query(f"""WITH {DAY}, w AS (SELECT subject_id, day, x AS bpm, n_events * 10 + n_view AS snr, n_events >= 2 AS passed FROM day), t AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY snr DESC, day) AS r FROM w WHERE passed),
b AS (SELECT subject_id, bpm AS top FROM t WHERE r = 1), n AS (SELECT t.subject_id, count(*) FILTER (abs(bpm - top) <= 5) AS near FROM t JOIN b USING (subject_id) GROUP BY 1)
SELECT subject_id, CAST(datediff('day', DATE '2024-01-01', day) AS INTEGER) AS start, round(bpm, 6) AS bpm, snr FROM t JOIN n USING (subject_id) WHERE r = 1 AND near >= 2""")
def best_window(spark, read):
    d = folds.event_days(read("events"))
    w = d.select("subject_id", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("start"), F.col("x").alias("bpm"), (F.col("n_events") * 10 + F.col("n_view")).alias("snr"), (F.col("n_events") >= 2).alias("passed"))
    return rounded(scans.best_window(w, ["subject_id"], 5.0), "bpm")


@query("""SELECT CASE WHEN hour(ts) BETWEEN 4 AND 10 THEN 'morning' WHEN hour(ts) BETWEEN 11 AND 19 THEN 'desk' ELSE 'night' END AS routine, count(*) AS n FROM events GROUP BY 1""")
def routine_by_hour(spark, read):
    return read("events").groupBy(scans.routine_of(F.hour("ts")).alias("routine")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS subject_id, event_type AS routine, CAST(min(hour(ts) * 60 + minute(ts)) AS INTEGER) AS mm FROM events GROUP BY 1, 2),
d AS (SELECT *, 600 - mm BETWEEN 0 AND 119 AS open, CASE WHEN mm > 600 THEN mm ELSE mm + 1440 END AS ahead FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY open DESC, mm DESC, routine DESC) AS rd, row_number() OVER (PARTITION BY subject_id ORDER BY ahead, routine) AS rn FROM d)
SELECT subject_id, max(routine) FILTER (rd = 1 AND open) AS due, max(routine) FILTER (rn = 1) AS next FROM r GROUP BY 1""")
def schedule_due(spark, read):
    s = read("events").groupBy(F.col("user_id").alias("subject_id"), F.col("event_type").alias("routine")).agg(F.min(F.hour("ts") * 60 + F.minute("ts")).alias("at")).withColumn("on", F.lit(True))
    return scans.due_now(s, F.lit(600), F.lit(False), 120)


@query(f"""WITH {DAY}, s AS (SELECT DISTINCT subject_id, day, CASE WHEN n_error >= 2 THEN 'ask' WHEN x > 120 THEN 'high' END AS status FROM day), n AS (SELECT subject_id, day, 'ask' AS status FROM day WHERE n_purchase > 0)
SELECT s.* FROM s ANTI JOIN n USING (subject_id, day, status) WHERE status IS NOT NULL""")
def notices(spark, read):
    d = folds.event_days(read("events"))
    states = d.select("subject_id", "day", F.when(F.col("n_error") >= 2, "ask").when(F.col("x") > 120, "high").alias("status"))
    return scans.new_notices(states, d.where("n_purchase > 0").select("subject_id", "day", F.lit("ask").alias("status")))


@query("""WITH r AS (SELECT user_id AS subject_id, 1 AS version, avg(value) FILTER (event_type = 'view') AS base, avg(value) FILTER (event_type = 'click') AS s1, avg(value) FILTER (event_type = 'error') AS s2 FROM events GROUP BY 1),
w AS (SELECT DISTINCT user_id AS subject_id, 1 AS version, CASE WHEN event_type = 'click' THEN 'one' WHEN event_type = 'error' THEN 'both' ELSE 'none' END AS segment_name FROM events)
SELECT subject_id, segment_name, round(CASE segment_name WHEN 'one' THEN s1 WHEN 'both' THEN list_aggregate(list_filter([s1, s2], lambda v: v IS NOT NULL), 'avg') END, 4) AS self_report,
  round(CASE segment_name WHEN 'one' THEN s1 WHEN 'both' THEN list_aggregate(list_filter([s1, s2], lambda v: v IS NOT NULL), 'avg') END - base, 4) AS self_report_delta, CASE segment_name WHEN 'one' THEN false WHEN 'both' THEN true END AS self_report_approx FROM w LEFT JOIN r USING (subject_id, version)""")
def self_reports(spark, read):
    e = read("events")
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    r = e.groupBy(F.col("user_id").alias("subject_id")).agg(mean("view").alias("base"), mean("click").alias("s1"), mean("error").alias("s2")).withColumn("version", F.lit(1))
    seg = F.when(F.col("event_type") == "click", "one").when(F.col("event_type") == "error", "both").otherwise("none")
    w = e.select(F.col("user_id").alias("subject_id"), F.lit(1).alias("version"), seg.alias("segment_name")).distinct()
    out = scans.attach_reports(w, r, {"one": ["s1"], "both": ["s1", "s2"]}, "base")
    return rounded(out.select("subject_id", "segment_name", "self_report", "self_report_delta", "self_report_approx"), "self_report", "self_report_delta", digits=4)


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS d, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1, 2),
m AS (SELECT 'view' AS feature, avg(CAST(view IS NULL AS INT)) AS missing FROM w UNION ALL SELECT 'click', avg(CAST(click IS NULL AS INT)) FROM w UNION ALL SELECT 'error', avg(CAST(error IS NULL AS INT)) FROM w)
SELECT feature, round(missing, 6) AS missing FROM m ORDER BY m.missing DESC, feature LIMIT 2""")
def missing_rates(spark, read):
    v = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k)
    w = read("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(v("view"), v("click"), v("error"))
    return rounded(scans.missing_rates(w, ["view", "click", "error"], 2), "missing")


@query("""SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1""")
def majority_vote(spark, read):
    return scans.majority(read("events"), ["user_id"], "event_type")


@query("""SELECT lang, source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2""")
def value_shares(spark, read):
    return rounded(scans.value_shares(read("documents"), "source", ("lang",)), "share")


@query("""SELECT a.event_id, a.value, b.value AS before_value FROM events a LEFT JOIN events b ON b.event_id = CASE WHEN a.event_id % 2 = 1 THEN a.event_id - 1 END""")
def scan_pairs(spark, read):
    e = read("events").select("event_id", "value").withColumn("pair", F.when(F.col("event_id") % 2 == 1, F.col("event_id") - 1))
    return scans.with_pair(e, "event_id", "pair", ["value"]).select("event_id", "value", "before_value")


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_view FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_click FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, day, n_view, n_click FROM a FULL JOIN b USING (user_id, day)""")
def day_tables_outer(spark, read):
    e = read("events").withColumn("day", F.to_date("ts"))
    part = lambda k, name: e.where(F.col("event_type") == k).groupBy("user_id", "day").agg(F.count("*").alias(name))
    return part("view", "n_view").join(part("click", "n_click"), ["user_id", "day"], "full_outer")


@query(f"""WITH {DAY}, e AS (SELECT DISTINCT subject_id FROM day WHERE n_error >= 2) SELECT subject_id, count(*) AS n, true AS had FROM day SEMI JOIN e USING (subject_id) GROUP BY 1 UNION ALL SELECT subject_id, count(*), false FROM day ANTI JOIN e USING (subject_id) GROUP BY 1""")
def subjects_with_events(spark, read):
    d = folds.event_days(read("events"))
    e = d.where("n_error >= 2").select("subject_id")
    count = lambda df, had: df.groupBy("subject_id").agg(F.count("*").alias("n")).withColumn("had", F.lit(had))
    return count(d.join(e, "subject_id", "left_semi"), True).unionByName(count(d.join(e, "subject_id", "left_anti"), False))


@query("""SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 25 THEN 1 WHEN p_size > 25 AND p_size <= 50 THEN 2 END AS bin, count(*) AS n FROM part GROUP BY 1""")
def right_closed_bins(spark, read):
    return read("part").groupBy(scores.cut_right_closed(F.col("p_size"), [0, 10, 25, 50]).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {DAY}, s AS (SELECT subject_id, day, 100 - least(x, 100) AS stress, CASE WHEN n_view > 0 THEN n_view * 30.0 END AS hrv, CASE WHEN n_click > 0 THEN n_click * 25.0 END AS hr FROM day)
SELECT subject_id, day, round(((100 - stress) * 0.35 + coalesce(hrv * 0.20, 0) + coalesce(hr * 0.15, 0)) / (0.35 + CASE WHEN hrv IS NULL THEN 0 ELSE 0.20 END + CASE WHEN hr IS NULL THEN 0 ELSE 0.15 END), 6) AS score FROM s""")
def health_scores(spark, read):
    d = folds.event_days(read("events"))
    s = scores.health_score(100 - F.least(F.col("x"), F.lit(100.0)), F.when(F.col("n_view") > 0, F.col("n_view") * 30.0), F.when(F.col("n_click") > 0, F.col("n_click") * 25.0), F.lit(None).cast("double"))
    return rounded(d.select("subject_id", "day", s.alias("score")), "score")
