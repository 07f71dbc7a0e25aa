"""Interval joins, time windows, runs and streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folds, intervals, windows
from tidemark.plans.registry import DAY, query, rounded

# Times are whole microseconds since 2024-01-01, as double seconds: both engines hold the same numbers.
SECONDS = "epoch_us(ts) / 1000000.0 - 1704067200.0"
EVENTS = f"""p AS (SELECT event_id, user_id AS subject_id, event_type, value, round({SECONDS}, 6) AS t FROM events),
e AS (SELECT event_id AS e_id, subject_id, t AS s, t + 7200.0 AS f, CAST(event_id % 3 AS BIGINT) AS level FROM p WHERE event_type = 'error')"""


def points(read):
    t = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200.0, 6)
    return read("events").select("event_id", F.col("user_id").alias("subject_id"), "event_type", "value", t.alias("t"))


def error_spans(p):
    return p.where("event_type = 'error'").select("event_id", "subject_id", F.col("t").alias("start"), (F.col("t") + 7200.0).alias("end"), (F.col("event_id") % 3).alias("level"))


@query(f"""WITH {EVENTS} SELECT event_id, coalesce((SELECT t < arg_max(f, s) FROM e WHERE e.subject_id = p.subject_id AND s <= t), false) AS inside FROM p WHERE event_type <> 'error'""")
def asof_span(spark, read):
    p = points(read)
    return intervals.within_span(p.where("event_type <> 'error'").select("event_id", "subject_id", "t"), error_spans(p)).select("event_id", "inside")


@query(f"""WITH {EVENTS}, w AS (SELECT event_id AS window_id, subject_id, t AS t0, t + 3600.0 AS t1 FROM p WHERE event_type = 'view'),
o AS (SELECT window_id, e_id, level, least(t1, f) - greatest(t0, s) AS o, row_number() OVER (PARTITION BY window_id ORDER BY least(t1, f) - greatest(t0, s) DESC, s, e_id) AS r FROM w JOIN e ON w.subject_id = e.subject_id AND s < t1 AND f > t0)
SELECT w.window_id, CASE WHEN o / 3600.0 >= 0.5 THEN e_id END AS event_id, CASE WHEN o / 3600.0 >= 0.5 THEN round(o, 6) END AS overlap,
  CASE WHEN o / 3600.0 >= 0.5 AND level = 0 THEN 'REPORTED_CALM' WHEN o / 3600.0 >= 0.5 AND level >= 1 THEN 'STRESS_EVENT' END AS label FROM w LEFT JOIN o ON w.window_id = o.window_id AND r = 1""")
def overlap_label(spark, read):
    p = points(read)
    w = p.where("event_type = 'view'").select(F.col("event_id").alias("window_id"), "subject_id", F.col("t").alias("t0"), (F.col("t") + 3600.0).alias("t1"))
    return rounded(intervals.label_by_overlap(w, error_spans(p)), "overlap").select("window_id", "event_id", "overlap", "label")


@query(f"""WITH {EVENTS}, s AS (SELECT event_id AS session_id, subject_id, t AS t0, t + 172800.0 AS t1 FROM p WHERE event_type = 'signup')
SELECT session_id, count(e_id) AS n_events FROM s LEFT JOIN e ON s.subject_id = e.subject_id AND e.s < t1 AND f > t0 GROUP BY 1""")
def overlap_count(spark, read):
    p = points(read)
    s = p.where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), "subject_id", F.col("t").alias("t0"), (F.col("t") + 172800.0).alias("t1"))
    return intervals.count_overlaps(s, error_spans(p)).select("session_id", "n_events")


@query(f"""WITH {EVENTS} SELECT event_id, round(min(greatest(0.0, s - t, t - f)) / 60.0, 4) AS minutes FROM p LEFT JOIN e USING (subject_id) WHERE event_type <> 'error' GROUP BY 1""")
def nearest_event(spark, read):
    p = points(read)
    out = intervals.minutes_to_nearest(p.where("event_type <> 'error'").select("event_id", "subject_id", "t"), error_spans(p))
    return rounded(out.select("event_id", "minutes"), "minutes", digits=4)


@query(f"""WITH {EVENTS} SELECT p.subject_id, e_id AS event_id, count(*) AS n, round(median(value), 6) AS median FROM p JOIN e ON p.subject_id = e.subject_id AND t BETWEEN s - 21600.0 AND f + 21600.0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def event_median(spark, read):
    p = points(read)
    return rounded(intervals.around_events(p.drop("event_id"), error_spans(p), "value", reach=21600.0, min_n=2), "median")


@query("""WITH a AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O')
SELECT a.o_custkey, a.d AS anchor, coalesce(max(s.d), a.d) AS event_day FROM a LEFT JOIN s ON a.o_custkey = s.o_custkey AND s.d BETWEEN a.d - 30 AND a.d GROUP BY 1, 2""")
def last_before_diagnosis(spark, read):
    o = read("orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return intervals.last_within(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), 30, "o_custkey")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true) AS ch FROM conversations),
g AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def label_runs(spark, read):
    return windows.label_runs(read("conversations"), "role", "turn", ["conv_id"]).withColumn("run", F.col("run").cast("bigint"))


@query(f"""WITH {EVENTS}, g AS (SELECT subject_id, t, row_number() OVER w AS seg, lead(t) OVER w AS nt FROM p WHERE event_type = 'signup' WINDOW w AS (PARTITION BY subject_id ORDER BY t))
SELECT subject_id, seg, t AS start, nt AS "end", (t + nt) / 2.0 AS half_start, CASE WHEN nt - t > 60 THEN (t + nt) / 2.0 - 30 ELSE t END AS mid_start FROM g WHERE nt IS NOT NULL""")
def tag_segments(spark, read):
    out = windows.tag_segments(points(read).where("event_type = 'signup'").select("subject_id", "t"))
    out = out.withColumn("half_start", windows.portion(F.col("start"), F.col("end"), "second_half")[0]).withColumn("mid_start", windows.portion(F.col("start"), F.col("end"), "middle_60s")[0])
    return out


@query(f"""WITH {EVENTS}, g AS (SELECT subject_id, t AS start, lead(t) OVER (PARTITION BY subject_id ORDER BY t) AS "end" FROM p WHERE event_type = 'signup'),
n AS (SELECT *, greatest(floor(("end" - start - 86400.0) / 43200.0 + 1e-9), 0) AS k FROM g WHERE "end" IS NOT NULL),
u AS (SELECT *, unnest(range(CAST(k AS BIGINT) + 1)) AS win FROM n)
SELECT subject_id, start, win, start + win * 43200.0 AS t0, CASE WHEN "end" - start < 86400.0 THEN "end" ELSE start + win * 43200.0 + 86400.0 END AS t1 FROM u""")
def sliding_windows(spark, read):
    seg = windows.tag_segments(points(read).where("event_type = 'signup'").select("subject_id", "t"))
    return windows.sliding_windows(seg, 86400.0, 43200.0).select("subject_id", "start", "win", "t0", "t1")


@query("""WITH s AS (SELECT user_id AS subject_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
e AS (SELECT *, unnest(range(greatest(0, CAST(ceil((pos - 10 + 1) / 5.0) AS BIGINT)), CAST(pos // 5 AS BIGINT) + 1)) AS win FROM s),
c AS (SELECT subject_id, win, event_type, count(*) AS c FROM e GROUP BY 1, 2, 3),
b AS (SELECT subject_id, win, CAST(sum(c) AS BIGINT) AS n, max(struct_pack(c := c, l := event_type)) AS b FROM c GROUP BY 1, 2)
SELECT subject_id, win, n, b.l AS label, round(b.c / n, 6) AS purity FROM b WHERE n = 10 AND b.c / n >= 0.4""")
def purity_windows(spark, read):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = read("events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("label"), pos.cast("bigint").alias("pos"))
    return rounded(windows.pure_windows(s, 10, 5, 0.4), "purity")


@query(f"""WITH {DAY}, i AS (SELECT subject_id, day, day - CAST(row_number() OVER (PARTITION BY subject_id ORDER BY day) AS INT) AS g FROM day)
SELECT subject_id, min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY subject_id, g""")
def streaks(spark, read):
    return windows.streaks(folds.event_days(read("events")))


@query(f"""WITH {DAY}, i AS (SELECT subject_id, day, day - CAST(row_number() OVER (PARTITION BY subject_id ORDER BY day) AS INT) AS g FROM day),
s AS (SELECT subject_id, max(day) AS last, count(*) AS n FROM i GROUP BY subject_id, g)
SELECT subject_id, max(CASE WHEN last BETWEEN DATE '2024-01-29' AND DATE '2024-01-30' THEN n ELSE 0 END) AS streak FROM s GROUP BY 1""")
def current_streak(spark, read):
    return windows.current_streak(folds.event_days(read("events")), F.lit("2024-01-30").cast("date"))


@query(f"""WITH {DAY}, r AS (SELECT subject_id, row_number() OVER w AS r, n_error > 0 AS f, sum(CAST(n_error = 0 AS INT)) OVER w AS b FROM day WINDOW w AS (PARTITION BY subject_id ORDER BY day DESC))
SELECT subject_id, count(*) FILTER (b = 0) AS streak, count(*) FILTER (r <= 3 AND f) AS recent FROM r GROUP BY 1""")
def unexplained_streak(spark, read):
    d = folds.event_days(read("events")).withColumn("f", F.col("n_error") > 0)
    return windows.trailing_run(d, "f", "day")


@query(f"""WITH {EVENTS}, g AS (SELECT subject_id, t, t - lag(t) OVER (PARTITION BY subject_id ORDER BY t) AS g FROM p)
SELECT subject_id, count(*) AS n, round(max(t) - min(t), 6) AS span, round(max(g), 6) AS max_gap, round(sum(CASE WHEN g <= 43200 THEN g ELSE 0 END) / nullif(max(t) - min(t), 0), 6) AS coverage FROM g GROUP BY 1""")
def gap_coverage(spark, read):
    return rounded(windows.coverage(points(read), ["subject_id"], hole=43200.0), "span", "max_gap", "coverage")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def dedupe_frames(spark, read):
    e = read("events").withColumn("d", F.to_date("ts"))
    return windows.first_of_time(e, ["user_id", "event_type"], "d", "event_id").select("event_id", "user_id", "event_type")
