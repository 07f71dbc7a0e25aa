"""Metrics, service reports, sinks, arrays and text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays, scores
from tidemark.operators import facts, folds, metrics, service
from tidemark.plans.registry import DAY, query, rounded
from tidemark.sources import text

PRED = """pr AS (SELECT d.doc_id, lang, n_chars, quality, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars < 60 THEN 'UNCERTAIN' WHEN n_chars > 6000 THEN 'bad' ELSE 'good' END AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
LABELS = ["good", "bad"]


def predictions(read):
    d = read("documents").select("doc_id", "lang", "n_chars").join(read("labels"), "doc_id")
    pred = F.when(F.col("n_chars") < 60, "UNCERTAIN").when(F.col("n_chars") > 6000, "bad").otherwise("good")
    return d.withColumn("truth", F.when(F.col("quality") == 1, "good").otherwise("bad")).withColumn("pred", pred)


@query(f"WITH {PRED} SELECT truth, pred, count(*) AS n FROM pr GROUP BY 1, 2")
def confusion(spark, read):
    return metrics.confusion(predictions(read), "truth", "pred")


def _metrics_sql(key: str = "") -> str:
    k, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    f1 = lambda c: f"coalesce(2.0 * count(*) FILTER (truth = '{c}' AND pred = '{c}') / nullif(count(*) FILTER (truth = '{c}') + count(*) FILTER (pred = '{c}'), 0), 0)"
    rec = lambda c: f"count(*) FILTER (truth = '{c}' AND pred = '{c}') / nullif(count(*) FILTER (truth = '{c}'), 0)"
    return f"""SELECT {k}count(*) AS n_test, round(count(*) FILTER (truth = pred) / count(*), 6) AS accuracy, round(({f1("good")} + {f1("bad")}) / 2, 6) AS macro_f1,
  round(list_aggregate(list_filter([{rec("good")}, {rec("bad")}], lambda v: v IS NOT NULL), 'avg'), 6) AS balanced_accuracy, round(count(*) FILTER (pred = 'UNCERTAIN') / count(*), 6) AS abstain_rate,
  round({f1("good")}, 6) AS f1_good, round({f1("bad")}, 6) AS f1_bad FROM pr {g}"""


RATES = ("accuracy", "macro_f1", "balanced_accuracy", "abstain_rate", "f1_good", "f1_bad")


@query(f"WITH {PRED} {_metrics_sql()}")
def class_metrics(spark, read):
    return rounded(metrics.class_metrics(predictions(read), "truth", "pred", LABELS), *RATES)


@query(f"WITH {PRED} {_metrics_sql('lang')}")
def per_subject_metrics(spark, read):
    return rounded(metrics.class_metrics(predictions(read), "truth", "pred", LABELS, ("lang",)), *RATES)


@query(f"""WITH {PRED} SELECT round(count(*) FILTER (truth <> pred AND n_chars > 3000) / nullif(count(*) FILTER (n_chars > 3000), 0), 6) AS flag_precision, round(count(*) FILTER (truth <> pred AND n_chars > 3000) / nullif(count(*) FILTER (truth <> pred), 0), 6) AS flag_recall FROM pr""")
def flag_metrics(spark, read):
    p = predictions(read).withColumn("flag", F.col("n_chars") > 3000)
    return rounded(metrics.flag_metrics(p, "truth", "pred", "flag"), "flag_precision", "flag_recall")


def _auc_sql(key: str = "") -> str:
    on, k = (f"AND a.{key} = b.{key}", f"a.{key}, ") if key else ("", "")
    k2 = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    return f"""c AS (SELECT {k2}count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg FROM pr {g}),
u AS (SELECT {k}sum(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END) AS u FROM pr a JOIN pr b ON a.quality = 1 AND b.quality <> 1 {on} {"GROUP BY a." + key if key else ""})"""


@query(f"WITH {PRED}, {_auc_sql()} SELECT n_pos, n_neg, round(CAST(u AS DOUBLE) / (n_pos * n_neg), 6) AS auc FROM c, u")
def auc_pooled(spark, read):
    return rounded(metrics.auc(predictions(read), "n_chars", F.col("quality") == 1), "auc")


@query(f"WITH {PRED}, {_auc_sql('lang')} SELECT c.lang, n_pos, n_neg, round(CAST(u AS DOUBLE) / (n_pos * n_neg), 6) AS auc FROM c LEFT JOIN u ON c.lang = u.lang")
def auc_by_subject(spark, read):
    return rounded(metrics.auc(predictions(read), "n_chars", F.col("quality") == 1, ("lang",), 5), "auc")


HALVES = f"""{DAY}, h AS (SELECT subject_id, median(x) FILTER (day < DATE '2024-01-16') AS a, median(x) FILTER (day >= DATE '2024-01-16') AS b FROM day GROUP BY 1),
d AS (SELECT *, a - b AS d, round(abs(a - b), 9) AS s FROM h WHERE a - b IS NOT NULL)"""


def halves(read):
    d = folds.event_days(read("events"))
    early = F.col("day") < F.lit("2024-01-16").cast("date")
    return d.groupBy("subject_id").agg(F.percentile(F.when(early, F.col("x")), F.lit(0.5)).alias("a"), F.percentile(F.when(~early, F.col("x")), F.lit(0.5)).alias("b"))


@query(f"""WITH {HALVES}, r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d WHERE s > 0),
t AS (SELECT count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS rp FROM r)
SELECT (SELECT count(*) FROM d) AS n, n_nonzero, round((SELECT median(d) FROM d), 6) AS median_diff, round(CAST(rp AS DOUBLE), 6) AS r_plus, round(2 * rp / (n_nonzero * (n_nonzero + 1) / 2.0) - 1, 6) AS effect_size FROM t""")
def wilcoxon_effect(spark, read):
    return rounded(metrics.wilcoxon(halves(read), "a", "b").drop("r_minus", "p_value"), "median_diff", "r_plus", "effect_size")


@query(f"""WITH {DAY}, r AS (SELECT subject_id, rank() OVER (PARTITION BY subject_id ORDER BY x) + (count(*) OVER (PARTITION BY subject_id, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY subject_id ORDER BY n_events) + (count(*) OVER (PARTITION BY subject_id, n_events) - 1) / 2.0 AS rb FROM day)
SELECT subject_id, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, read):
    return rounded(metrics.spearman(folds.event_days(read("events")), "x", "n_events", ("subject_id",)), "rho")


@query("""WITH t AS (SELECT l_quantity AS truth, l_extendedprice / 1500.0 AS est, CASE WHEN l_discount <= 0.03 THEN 'low' WHEN l_discount <= 0.07 THEN 'mid' ELSE 'high' END AS band FROM lineitem)
SELECT band, count(*) AS n, round(avg(abs(est - truth)), 4) AS mae, round(sqrt(avg((est - truth) ** 2)), 4) AS rmse, round(avg(CAST(abs(est - truth) <= 5 AS INT)), 4) AS within FROM t GROUP BY 1""")
def error_bands(spark, read):
    t = read("lineitem").select(F.col("l_quantity").alias("truth"), (F.col("l_extendedprice") / 1500.0).alias("est"), "l_discount")
    band = F.when(F.col("l_discount") <= 0.03, "low").when(F.col("l_discount") <= 0.07, "mid").otherwise("high")
    return rounded(metrics.error_bands(t, "truth", "est", band), "mae", "rmse", "within", digits=4)


@query(f"""WITH {PRED}, c AS (SELECT lang, count(*) FILTER (truth = pred) AS h, CAST(count(*) AS DOUBLE) AS n FROM pr GROUP BY 1)
SELECT lang, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
  round((h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM c""")
def wilson_ci(spark, read):
    c = predictions(read).groupBy("lang").agg(F.count_if(F.col("truth") == F.col("pred")).alias("h"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("h"), F.col("n"))
    return rounded(c.select("lang", low.alias("low"), high.alias("high")), "low", "high")


@query(f"""WITH {DAY} SELECT subject_id, count(x) FILTER (n_purchase > 0) AS n_on, count(x) FILTER (NOT n_purchase > 0) AS n_off, round(median(x) FILTER (n_purchase > 0) - median(x) FILTER (NOT n_purchase > 0), 6) AS effect
FROM day GROUP BY 1 HAVING count(x) FILTER (n_purchase > 0) >= 3 AND count(x) FILTER (NOT n_purchase > 0) >= 3""")
def paired_effect(spark, read):
    d = folds.event_days(read("events")).withColumn("on", F.col("n_purchase") > 0)
    return rounded(metrics.paired_effect(d, "x", "on"), "effect")


@query(f"""WITH {DAY}, b AS (SELECT *, median(x) FILTER (n_error = 0) OVER (PARTITION BY subject_id) AS base FROM day)
SELECT subject_id, day, CASE WHEN base IS NULL THEN NULL WHEN x >= base * 1.1 THEN 'HIGH' WHEN x <= base / 1.1 THEN 'LOW' ELSE 'NORMAL' END AS state FROM b""")
def state_ratio(spark, read):
    from pyspark.sql import Window

    d = folds.event_days(read("events"))
    base = F.percentile(F.when(F.col("n_error") == 0, F.col("x")), F.lit(0.5)).over(Window.partitionBy("subject_id"))
    return d.withColumn("base", base).select("subject_id", "day", service.state_by_ratio(F.col("x"), F.col("base"), 1.1).alias("state"))


@query(f"""WITH {DAY} SELECT subject_id, day, list_aggregate(list_slice(list_filter([CASE WHEN n_error > 0 THEN 'fix' END, CASE WHEN x > 80 THEN 'calm' END, CASE WHEN n_purchase = 0 THEN 'move' END, CASE WHEN n_view > 1 THEN 'rest' END, CASE WHEN n_click > 0 THEN 'sleep' END], lambda v: v IS NOT NULL), 1, 3), 'string_agg', ',') AS tips FROM day""")
def tips_top3(spark, read):
    d = folds.event_days(read("events"))
    tips = service.first_tips([(F.col("n_error") > 0, "fix"), (F.col("x") > 80, "calm"), (F.col("n_purchase") == 0, "move"), (F.col("n_view") > 1, "rest"), (F.col("n_click") > 0, "sleep")])
    return d.select("subject_id", "day", F.when(F.size(tips) > 0, F.array_join(tips, ",")).alias("tips"))


@query("""SELECT event_id, CASE WHEN hour(ts) >= 23 OR hour(ts) < 4 THEN 'wrap' WHEN value < 20 OR CAST(json_extract(props, '$.k') AS BIGINT) >= 90 THEN 'light' WHEN value >= 75 AND CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN 'deep' ELSE 'split' END AS mode FROM events""")
def study_mode(spark, read):
    k = F.get_json_object("props", "$.k").try_cast("int")
    score = F.when(F.col("value") < 20, 10).when(F.col("value") >= 75, 80).otherwise(60)
    return read("events").select("event_id", service.study_mode(F.hour("ts"), score, F.when(k >= 90, 70).when(k < 50, 10).otherwise(60), F.lit(None).cast("double")).alias("mode"))


@query(f"""WITH {DAY}, l AS (SELECT subject_id, arg_max(x, day) AS x, max(day) AS day, count(*) AS n FROM day GROUP BY 1)
SELECT subject_id, day, round(x, 6) AS x, CASE WHEN x > 80 THEN 0 WHEN day < DATE '2024-01-29' THEN 2 ELSE 1 END AS urgency FROM l ORDER BY urgency, day DESC NULLS LAST, subject_id""")
def group_board_order(spark, read):
    d = folds.event_days(read("events")).groupBy("subject_id").agg(F.max_by("x", "day").alias("x"), F.max("day").alias("day"))
    urgency = F.when(F.col("x") > 80, 0).when(F.col("day") < F.lit("2024-01-29").cast("date"), 2).otherwise(1)
    return rounded(d.withColumn("urgency", urgency).orderBy("urgency", F.col("day").desc_nulls_last(), "subject_id"), "x").select("subject_id", "day", "x", "urgency")


@query(f"""WITH {DAY}, n AS (SELECT event_type, count(*) AS n, median(value) AS m, min(CAST(ts AS DATE)) FILTER (value < 1) AS first_low FROM events GROUP BY 1)
SELECT event_type, n, round(m, 6) AS median, first_low, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM n""")
def report_summary(spark, read):
    from pyspark.sql import Window

    n = read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.min(F.when(F.col("value") < 1, F.to_date("ts"))).alias("first_low"))
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "event_type")).cast("bigint")  # one row per event type
    return rounded(n.withColumn("place", place), "median")


@query(f"""WITH {DAY}, f AS (SELECT subject_id, day, CASE WHEN n_view > 0 THEN (x - 50) / 25.0 END AS nz, CASE WHEN n_click > 0 THEN n_events / 2.0 END AS fz FROM day)
SELECT subject_id, day, round(CASE WHEN nz IS NULL THEN fz * 2.0 / 2.5 WHEN nz >= 1.5 AND nz < 2 AND fz >= 2 THEN 2.0 ELSE nz END, 6) AS z, CASE WHEN nz IS NULL AND fz IS NULL THEN 'none' WHEN nz IS NULL THEN 'face' WHEN coalesce(nz >= 1.5 AND nz < 2 AND fz >= 2, false) THEN 'border' ELSE 'night' END AS source FROM f""")
def night_face_fusion(spark, read):
    d = folds.event_days(read("events")).withColumn("nz", F.when(F.col("n_view") > 0, (F.col("x") - 50) / 25.0)).withColumn("fz", F.when(F.col("n_click") > 0, F.col("n_events") / 2.0))
    z, source = service.fuse(F.col("nz"), F.col("fz"))
    return rounded(d.select("subject_id", "day", z.alias("z"), source.alias("source")), "z")


@query("""WITH f AS (SELECT user_id AS subject_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1), s AS (SELECT *, len(v) AS n, v[len(v) - 3:] AS l, list_sort(v[1:len(v) - 4]) AS b FROM f WHERE len(v) >= 8),
h AS (SELECT *, list_aggregate(b[1:greatest(len(b) // 2, 1)], 'median') AS st FROM s)
SELECT subject_id, CAST(n AS BIGINT) AS n, round(list_aggregate(l, 'avg') - st, 6) AS rise, len(list_filter(l, lambda x: x - st >= 6)) / len(l) >= 0.75 AS rising FROM h""")
def intraday_rise(spark, read):
    e = read("events").withColumnRenamed("user_id", "subject_id").withColumn("o", F.struct("ts", "event_id"))
    return rounded(service.intraday_rise(e, "value", "o", ("subject_id",)), "rise")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def results_upsert(spark, read):
    return facts.keep_last(read("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 24""")
def capped_latest(spark, read):
    return facts.keep_newest(read("events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 24).select("user_id", "event_id")


V = """v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(0.8 + x, 6)) AS v FROM embeddings),
d AS (SELECT *, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS d FROM v)"""


def vectors(read):
    return read("embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(F.lit(0.8) + x, 6)).alias("v"))


@query(f"""WITH {V} SELECT vec_id, round(list_aggregate(v, 'avg'), 6) AS mean, round(list_aggregate(v, 'stddev_samp'), 6) AS sdnn, round(sqrt(list_aggregate(list_transform(d, lambda x: x * x), 'avg')), 6) AS rmssd, round(len(list_filter(d, lambda x: abs(x) > 0.05)) * 100.0 / len(d), 6) AS pnn50 FROM d""")
def array_time_hrv(spark, read):
    v = F.col("v")
    out = vectors(read).select("vec_id", arrays.mean(v).alias("mean"), arrays.sd(v, 1).alias("sdnn"), arrays.rmssd(v).alias("rmssd"), arrays.share_above(v, 0.05).alias("pnn50"))
    return rounded(out, "mean", "sdnn", "rmssd", "pnn50")


@query(f"""WITH {V} SELECT vec_id, round(coalesce(list_aggregate(list_filter(d, lambda x: x > 0), 'avg') * 4.0, 0), 4) AS up, round(coalesce(list_aggregate(list_filter(d, lambda x: x < 0), 'avg') * 4.0, 0), 4) AS down FROM d""")
def array_ratio_up_down(spark, read):
    v = F.col("v")
    return rounded(vectors(read).select("vec_id", arrays.mean_slope(v, 4.0).alias("up"), arrays.mean_slope(v, 4.0, up=False).alias("down")), "up", "down", digits=4)


@query(f"""WITH {V}, r AS (SELECT vec_id, v, list_aggregate(list_filter(v, lambda x: x BETWEEN 0.3 AND 2.0), 'median') AS m FROM v),
k AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x BETWEEN 0.3 AND 2.0 AND abs(x - m) <= 0.3 * m THEN x END) AS k FROM r),
n AS (SELECT vec_id, k, list_transform(range(1, len(k) + 1), lambda i: list_filter([CASE WHEN i > 2 THEN k[i - 2] END, CASE WHEN i > 1 THEN k[i - 1] END, k[i + 1], k[i + 2]], lambda o: o IS NOT NULL)) AS o FROM k)
SELECT vec_id, CAST(len(list_filter(range(1, len(k) + 1), lambda i: k[i] IS NOT NULL AND (len(o[i]) < 2 OR abs(k[i] - list_aggregate(o[i], 'median')) <= 0.2 * list_aggregate(o[i], 'median')))) AS BIGINT) AS kept FROM n""")
def ibi_clean_neighbour(spark, read):
    return vectors(read).select("vec_id", F.size(arrays.clean_intervals(F.col("v"), "neighbour", 0.2)).cast("bigint").alias("kept"))


@query(f"""WITH {V}, b AS (SELECT vec_id, unnest(v) AS x FROM v), c AS (SELECT vec_id, floor(x / 0.05) AS b, count(*) AS c FROM b GROUP BY 1, 2),
m AS (SELECT vec_id, c, b, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, b) AS r FROM c)
SELECT v.vec_id, round(100.0 * c / len(v) / (2 * ((b + 0.5) * 0.05) * greatest(list_max(v) - list_min(v), 0.05)), 6) AS si FROM v JOIN m ON v.vec_id = m.vec_id AND r = 1""")
def baevsky_si(spark, read):
    return rounded(vectors(read).select("vec_id", arrays.stress_index(F.col("v")).alias("si")), "si")


@query(f"""WITH {V}, r AS (SELECT vec_id, list_filter(v, lambda x: x BETWEEN 0.3 AND 2.0) AS r FROM v), m AS (SELECT *, list_aggregate(r, 'median') AS m FROM r)
SELECT vec_id, CAST(len(list_filter(r, lambda x: abs(x - m) <= 0.1 * m)) AS BIGINT) AS kept, round(list_sum(list_filter(r, lambda x: abs(x - m) <= 0.1 * m)), 6) AS total FROM m""")
def ibi_clean_median(spark, read):
    out = vectors(read).withColumn("k", arrays.clean_intervals(F.col("v"), "median", 0.1))
    return rounded(out.select("vec_id", F.size("k").cast("bigint").alias("kept"), arrays.total(F.col("k")).alias("total")), "total")


@query(f"""WITH RECURSIVE {V}, s AS (SELECT vec_id, v, 1 AS i, NULL::DOUBLE AS last, 0 AS kept FROM v UNION ALL
  SELECT vec_id, v, i + 1, CASE WHEN v[i] BETWEEN 0.3 AND 2.0 AND (last IS NULL OR abs(v[i] - last) <= 0.2 * last) THEN v[i] ELSE last END, kept + CAST(v[i] BETWEEN 0.3 AND 2.0 AND (last IS NULL OR abs(v[i] - last) <= 0.2 * last) AS INT) FROM s WHERE i <= len(v))
SELECT vec_id, CAST(kept AS BIGINT) AS kept FROM s WHERE i = len(v) + 1""")
def ibi_clean_previous(spark, read):
    return vectors(read).select("vec_id", F.size(arrays.clean_intervals(F.col("v"), "previous", 0.2)).cast("bigint").alias("kept"))


@query(f"""WITH {V}, q AS (SELECT vec_id, list_aggregate(v, 'avg') * 100 AS si FROM v), s AS (SELECT *, 100 * greatest(0.0, least(1.0, (ln(si) - ln(50.0)) / (ln(1000.0) - ln(50.0)))) AS score FROM q)
SELECT vec_id, round(score, 6) AS score, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'normal' WHEN score < 80 THEN 'high' ELSE 'very_high' END AS zone FROM s""")
def stress_scores(spark, read):
    out = vectors(read).withColumn("score", scores.stress_score(arrays.mean(F.col("v")) * 100))
    return rounded(out.select("vec_id", "score", scores.stress_zone(F.col("score")).alias("zone")), "score")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_props_explode(spark, read):
    return text.json_items(read("events").select("event_id", "props"), "props", "map<string,bigint>").where("key = 'k'").select("event_id", F.col("value").alias("k"))


@query("""WITH h AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages)
SELECT page_id, lang, CAST(length(title) AS BIGINT) AS title_chars, CAST(links AS BIGINT) AS links FROM h""")
def text_table_import(spark, read):
    return text.page_table(read("pages"))


@query("""SELECT count(*) AS n, count(*) FILTER (m BETWEEN 180 AND 900) AS kept, round(avg(m) FILTER (m BETWEEN 180 AND 900), 6) AS mean FROM (SELECT CASE WHEN value <= 16 THEN value * 60 ELSE value END AS m FROM events)""")
def hours_or_minutes(spark, read):
    m = text.as_minutes(F.col("value"))
    ok = m.between(180, 900)
    return rounded(read("events").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.avg(F.when(ok, m)).alias("mean")), "mean")
