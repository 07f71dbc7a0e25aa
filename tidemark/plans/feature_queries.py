"""Feature bundles over vectors, splits and their leaks, effects against noise, the first half of the days, final states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import bundles
from tidemark.operators import folds, metrics, service, windows
from tidemark.plans import judgement
from tidemark.plans.registry import DAY, query, rounded

AXES = """v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(10 * x, 6)) AS e FROM embeddings),
a AS (SELECT vec_id, e[1:20] AS x, e[21:40] AS y, e[41:60] AS z FROM v)"""


def axes(read):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 10, 6))
    return read("embeddings").select("vec_id", *[F.slice(e, 1 + 20 * k, 20).alias(c) for k, c in enumerate("xyz")])


def bundled(df, key: str, features: dict, digits: int = 9):
    return rounded(df.select(key, *[c.alias(n) for n, c in features.items()]), *features, digits=digits)


_EACH = ", ".join(f"round(list_aggregate({c}, 'avg') / 64, 9) AS {c}_mean, round(list_aggregate({c}, 'stddev_samp') / 64, 9) AS {c}_std" for c in "xyz")


@query(f"""WITH {AXES}, m AS (SELECT *, list_transform(range(1, 21), lambda i: sqrt(x[i] ** 2 + y[i] ** 2 + z[i] ** 2) / 64) AS m FROM a), d AS (SELECT *, list_transform(range(1, 20), lambda i: m[i + 1] - m[i]) AS d, list_aggregate(m, 'median') AS c FROM m)
SELECT vec_id, {_EACH}, round(list_aggregate(m, 'avg'), 9) AS acc_mean, round(list_aggregate(m, 'stddev_samp'), 9) AS acc_std, round(coalesce(list_aggregate(list_filter(d, lambda v: v > 0), 'avg') * 32, 0), 9) AS acc_ratio_up,
  round(coalesce(list_aggregate(list_filter(d, lambda v: v < 0), 'avg') * 32, 0), 9) AS acc_ratio_down, round(list_aggregate(list_transform(m, lambda v: abs(v - c)), 'avg'), 9) AS acc_dyn_mean FROM d""")
def acc_features(spark, read):
    return bundled(axes(read), "vec_id", bundles.acceleration({c: F.col(c) for c in "xyz"}))


@query(f"""WITH {AXES}, d AS (SELECT vec_id, x, list_transform(range(1, 20), lambda i: x[i + 1] - x[i]) AS d FROM a)
SELECT vec_id, round(list_aggregate(x, 'avg'), 9) AS hr_mean, round(list_aggregate(x, 'stddev_samp'), 9) AS hr_std, round(coalesce(list_aggregate(list_filter(d, lambda v: v > 0), 'avg'), 0), 9) AS hr_ratio_up, round(coalesce(list_aggregate(list_filter(d, lambda v: v < 0), 'avg'), 0), 9) AS hr_ratio_down FROM d""")
def hr_features(spark, read):
    return bundled(axes(read), "vec_id", bundles.heart_rate(F.col("x")))


@query(f"""WITH {AXES}, u AS (SELECT vec_id, unnest(x) AS tx, unnest(y) AS ty, unnest(z) AS tz, unnest(range(20)) / 4.0 AS t FROM a)
SELECT vec_id, round(avg(tx), 9) AS TEMP_mean, round(stddev_samp(tx), 9) AS TEMP_std, round(regr_slope(tx, t), 9) AS TEMP_slope, round(avg(sqrt(tx * tx + ty * ty + tz * tz)), 9) AS ACC_magnitude_mean,
  round(stddev_samp(sqrt(tx * tx + ty * ty + tz * tz)), 9) AS ACC_magnitude_std, round(avg(tx * tx + ty * ty + tz * tz), 9) AS ACC_energy FROM u GROUP BY 1""")
def window_features(spark, read):
    return bundled(axes(read), "vec_id", bundles.temperature(F.col("x")) | bundles.movement({c: F.col(c) for c in "xyz"}))


@query(f"""WITH {DAY}, f AS (SELECT subject_id, (subject_id + CAST(n_view > 0 AND n_click > 1 AS INT)) % 3 AS fold, CASE WHEN n_purchase >= 2 THEN 'EXERCISE' WHEN n_error >= 1 THEN 'STRESS' ELSE 'REST' END AS label FROM day),
t AS (SELECT *, count(DISTINCT fold) OVER (PARTITION BY subject_id) AS folds FROM f), w AS (SELECT count(*) AS n, count(DISTINCT subject_id) AS s FROM f)
SELECT fold, n - count(*) AS n_train, count(*) AS n_test, s - count(DISTINCT subject_id) FILTER (folds = 1) AS train_subjects, count(DISTINCT subject_id) AS test_subjects, count(DISTINCT label) AS test_classes, count(*) FILTER (folds > 1) > 0 AS leak FROM t, w GROUP BY fold, n, s""")
def split_summary(spark, read):
    """Folds that tear some subjects apart, and what that leaks."""
    d = folds.event_days(read("events"))
    label = F.when(F.col("n_purchase") >= 2, "EXERCISE").when(F.col("n_error") >= 1, "STRESS").otherwise("REST")
    fold = (F.col("subject_id") + ((F.col("n_view") > 0) & (F.col("n_click") > 1)).cast("int")) % 3
    return metrics.split_summary(d.select("subject_id", label.alias("label"), fold.alias("fold")))


@query(f"""WITH {DAY}, g AS (SELECT stddev_samp(x) AS sd FROM day GROUP BY subject_id), p AS (SELECT subject_id, avg(x) FILTER (n_purchase = 0) AS b, avg(x) FILTER (n_purchase > 0) AS a FROM day GROUP BY 1), w AS (SELECT median(sd) AS within_sd FROM g)
SELECT round(within_sd, 5) AS within_sd, round(stddev_samp(b), 5) AS between_sd, round(median(a - b), 5) AS effect_median, round(avg(CAST(a > b AS INT)) FILTER (a - b IS NOT NULL), 5) AS up_after, round(median(abs(a - b)) / within_sd, 5) AS effect_over_noise FROM p, w GROUP BY within_sd""")
def effect_over_noise(spark, read):
    d = folds.event_days(read("events"))
    pairs = d.groupBy("subject_id").agg(F.avg(F.when(F.col("n_purchase") == 0, F.col("x"))).alias("before"), F.avg(F.when(F.col("n_purchase") > 0, F.col("x"))).alias("after"))
    return rounded(metrics.effect_over_noise(d, pairs, "x", ("subject_id",)), "within_sd", "between_sd", "effect_median", "up_after", "effect_over_noise", digits=5)


@query(f"""WITH {DAY}, r AS (SELECT subject_id, day, dense_rank() OVER (PARTITION BY subject_id ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY subject_id) AS n FROM day) SELECT subject_id, day, k <= n // 2 AS is_train FROM r""")
def first_half_of_days(spark, read):
    return windows.first_half_of_days(folds.event_days(read("events")).select("subject_id", "day"))


_STATE = "CASE WHEN NOT valid THEN CASE WHEN n_events >= 1 AND n_view > 0 THEN 'learning' WHEN n_click > 0 THEN 'learning' ELSE 'none' END WHEN NOT deviated THEN 'calm' WHEN n_signup > 1 THEN 'ask' WHEN held THEN 'explained' WHEN alert THEN 'alert' ELSE 'left' END"


@query(f"WITH RECURSIVE {judgement.ALERTS} SELECT subject_id, day, {_STATE} AS state FROM al")
def final_state(spark, read):
    """The state shown for each day: its verdict, what explains it, and whether it alerts."""
    d = judgement.alert_table(read).withColumn("pending", F.col("n_signup") > 1).withColumn("face_valid", F.col("n_click") > 0)
    d = d.withColumn("night_hr", F.when(F.col("n_view") > 0, F.col("x"))).withColumn("night_min", F.col("n_events") * 60)
    return service.final_state(d).select("subject_id", "day", "state")


@query(f"WITH RECURSIVE {judgement.ALERTS} SELECT subject_id, coalesce(CAST(arg_max(run_len, day) FILTER (valid AND NOT held) AS BIGINT), 0) AS run FROM al GROUP BY 1")
def shown_run(spark, read):
    return service.shown_run(judgement.alert_table(read))
