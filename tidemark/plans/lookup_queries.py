"""Lookups, slices, complexion, shares, sentences and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scores, sentences
from tidemark.operators import alerts, explain, folds, lookups, metrics, service, windows
from tidemark.plans import judgement
from tidemark.plans.registry import DAY, past, query, rounded

CAUSE = {"purchase": "음주", "signup": "카페인", "error": "운동(달리기)"}


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN '음주' WHEN 'signup' THEN '카페인' WHEN 'error' THEN '운동(달리기)' ELSE 'unknown' END AS cause, count(*) AS n FROM events GROUP BY 1, 2")
def map_lookup(spark, read):
    return read("events").groupBy("event_type", lookups.looked_up(F.col("event_type"), CAUSE, "unknown").alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT CASE label WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM embeddings GROUP BY 1")
def split_lookup(spark, read):
    """Vectors by the fixed split of their label; the labels are those of the table."""
    splits = {"train": tuple(range(2, 64)), "val": (0,), "test": (1,)}
    return read("embeddings").groupBy(lookups.fixed_split(F.col("label"), splits).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT l.doc_id, l.quality, d.n_chars, d.lang FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def aligned_features(spark, read):
    """A row for each label with the features of its document."""
    return lookups.aligned(read("labels").select("doc_id", "quality"), read("documents").select("doc_id", "n_chars", "lang"), "doc_id")


@query("""WITH m AS (SELECT user_id, nullif(event_type, 'error') AS mid FROM events), d AS (SELECT DISTINCT user_id, mid FROM m)
SELECT d.user_id, d.mid, (SELECT count(*) FROM m WHERE m.mid IS NOT DISTINCT FROM d.mid) AS same FROM d""")
def null_safe_match(spark, read):
    """Every user's modes, the unknown one among them, with the rows of that mode."""
    m = read("events").select("user_id", F.expr("nullif(event_type, 'error')").alias("mid"))
    return lookups.same_or_both_null(m.distinct(), m.select("mid"), "mid", "same")


@query("""SELECT user_id AS subject_id, round(median(value) FILTER (event_type = 'view'), 6) AS "view", round(median(value) FILTER (event_type = 'click'), 6) AS click, round(median(value) FILTER (event_type = 'error'), 6) AS error
FROM events GROUP BY 1 HAVING count(value) FILTER (event_type = 'view') > 0 AND count(value) FILTER (event_type = 'click') > 0 AND count(value) FILTER (event_type = 'error') > 0""")
def median_pivot(spark, read):
    """Medians by subject and state; subjects without a value in one of the states are left out."""
    e = read("events").withColumnRenamed("user_id", "subject_id")
    return rounded(metrics.median_by_state(e, "value", "event_type", ["view", "click", "error"]), "view", "click", "error")


@query("""WITH s AS (SELECT vec_id, embedding AS e, (vec_id % 7) * 0.375 AS a, (vec_id % 7) * 0.375 + 2.125 AS b FROM embeddings),
i AS (SELECT *, CAST(ceil(a * 4) AS INT) AS c0, CAST(floor(b * 4) AS INT) AS c1, CAST(round_even(a * 4, 0) AS INT) AS r0, CAST(round_even(b * 4, 0) AS INT) AS r1 FROM s)
SELECT vec_id, len(e[c0 + 1:c1]) AS n_inside, round(list_sum(list_transform(e[c0 + 1:c1], lambda v: CAST(v AS DOUBLE))), 6) AS sum_inside, len(e[r0 + 1:r1]) AS n_near, round(list_sum(list_transform(e[r0 + 1:r1], lambda v: CAST(v AS DOUBLE))), 6) AS sum_near FROM i""")
def window_slices(spark, read):
    """One stretch of each vector at 4 Hz by both conventions: samples within it, and ends rounded half to even."""
    start = (F.col("vec_id") % 7) * 0.375
    cut = lambda how: windows.slice_between(F.col("embedding"), 4.0, F.lit(0.0), start, start + 2.125, how)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))
    d = read("embeddings").withColumn("_in", cut("ceil_floor")).withColumn("_near", cut("round"))
    out = d.select("vec_id", F.size("_in").cast("bigint").alias("n_inside"), total(F.col("_in")).alias("sum_inside"), F.size("_near").cast("bigint").alias("n_near"), total(F.col("_near")).alias("sum_near"))
    return rounded(out, "sum_inside", "sum_near")


@query(f"""WITH {DAY}, a AS (SELECT subject_id, day, n_view * 12 AS very_active, n_click * 60 + n_events * 40 + 300 AS asleep FROM day),
q AS (SELECT *, list(very_active) OVER {past(28, 0)} AS la, list(asleep) OVER {past(28, 0)} AS ls, lag(day) OVER w AS before FROM a WINDOW w AS (PARTITION BY subject_id ORDER BY day)),
h AS (SELECT *, very_active > 0 AND (very_active >= 30 OR coalesce(len(la) >= 14 AND very_active >= list_aggregate(la, 'quantile_cont', 0.9), false)) AS active FROM q)
SELECT subject_id, day, coalesce(datediff('day', before, day) = 1 AND lag(active) OVER (PARTITION BY subject_id ORDER BY day), false) AS exercise,
  asleep < 360 OR coalesce(len(ls) >= 14 AND asleep <= list_aggregate(ls, 'quantile_cont', 0.1), false) AS sleep_debt FROM h""")
def day_causes(spark, read):
    d = folds.event_days(read("events"))
    d = d.select("subject_id", "day", "valid", (F.col("n_view") * 12).alias("very_active"), (F.col("n_click") * 60 + F.col("n_events") * 40 + 300).alias("asleep"))
    return explain.day_causes(d).select("subject_id", "day", "exercise", "sleep_debt")


@query(f"""WITH {DAY}, s AS (SELECT subject_id, day, CAST(n_events * 10 AS DOUBLE) AS total, greatest(n_view * 4.0, n_click * 9.0) AS a, greatest(n_error * 6.0, 0.0) AS b, n_purchase * 20.0 AS c FROM day),
t AS (SELECT *, least(a, total) AS ta FROM s), u AS (SELECT *, least(b, total - ta) AS tb FROM t), v AS (SELECT *, least(c, total - ta - tb) AS tc FROM u),
r AS (SELECT *, greatest(0, CAST(round((total - ta - tb - tc) / total * 100) AS INT)) AS rest FROM v)
SELECT subject_id, day, [ta, tb, tc] AS shares, rest, rest >= 60 AS alerting FROM r""")
def share_gauge(spark, read):
    """How much of a day's deviation each cause explains, and what they leave."""
    d = folds.event_days(read("events"))
    n = lambda c, w: F.col(c) * F.lit(w)
    total = F.col("n_events") * 10.0
    shares = service.share_gauge(total, [(n("n_view", 4.0), n("n_click", 9.0)), (n("n_error", 6.0), F.lit(None).cast("double")), (F.lit(None).cast("double"), n("n_purchase", 20.0))])
    rest, alerting = service.unexplained_share(total, F.col("shares"), F.lit(True))
    return d.withColumn("shares", shares).select("subject_id", "day", "shares", rest.alias("rest"), alerting.alias("alerting"))


def _lab_sql(c: str) -> str:
    """Redness (a*) of a list of three colours in SQL."""
    lin = lambda k: f"(CASE WHEN {c}[{k}] / 255.0 <= 0.04045 THEN {c}[{k}] / 255.0 / 12.92 ELSE pow(({c}[{k}] / 255.0 + 0.055) / 1.055, 2.4) END)"
    f = lambda t: f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END)"
    x = f"((0.4124 * {lin(1)} + 0.3576 * {lin(2)} + 0.1805 * {lin(3)}) / 0.95047)"
    y = f"(0.2126 * {lin(1)} + 0.7152 * {lin(2)} + 0.0722 * {lin(3)})"
    return f"500 * ({f(x)} - {f(y)})"


def _saturation_sql(c: str) -> str:
    return f"(list_max({c}) - list_min({c})) / list_max({c})"


@query(f"""WITH k AS (SELECT vec_id, embedding AS e, unnest(range(20)) AS k FROM embeddings),
c AS (SELECT vec_id, k, [CAST(round(150 + e[3 * k + 1] * 100) AS DOUBLE), CAST(round(110 + e[3 * k + 2] * 100) AS DOUBLE), CAST(round(90 + e[3 * k + 3] * 100) AS DOUBLE)] AS f FROM k),
p AS (SELECT a.vec_id, a.f AS f, b.f AS c FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.k = 19 - a.k WHERE a.k % 5 <> 4),
v AS (SELECT vec_id, {_lab_sql("f")} AS af, {_lab_sql("c")} AS ac, {_saturation_sql("f")} AS sf, {_saturation_sql("c")} AS sc, f[1] / f[2] AS rf, c[1] / c[2] AS rc FROM p)
SELECT vec_id, round(median(ac - af), 6) AS a_rel, round(median(ac), 6) AS a_cheek, round(median(sc - sf), 6) AS s_rel, round(median(rc - rf), 6) AS rg_rel FROM v GROUP BY 1""")
def complexion(spark, read):
    """Redness of one region against another over twenty frames, of which every fifth is unknown."""
    single = lambda v: F.lit(v).cast("float")  # noqa: E731 - SQL reckons the table's floats as floats: in doubles some halves are none
    value = lambda k, base: F.round(single(base) + F.get("embedding", k).cast("float") * single(100)).cast("double")
    frame = lambda k: F.array(value(3 * k, 150), value(3 * k + 1, 110), value(3 * k + 2, 90))
    numbers = F.sequence(F.lit(0), F.lit(19))
    d = read("embeddings").withColumn("f", F.transform(numbers, lambda k: F.when(k % 5 != 4, frame(k)))).withColumn("c", F.transform(numbers, lambda k: frame(19 - k)))
    out = d.select("vec_id", *[v.alias(n) for n, v in scores.complexion(F.col("f"), F.col("c")).items()])
    return rounded(out, "a_rel", "a_cheek", "s_rel", "rg_rel")


@query(f"""WITH {DAY}, j AS (SELECT *, avg(x) OVER (PARTITION BY subject_id) AS base FROM day)
SELECT subject_id, day, CASE WHEN n_purchase > 0 THEN 'excluded' WHEN x IS NULL OR n_events < 2 THEN 'building' WHEN abs(x - 90.0) >= 75.0 THEN 'diff' ELSE 'same' END AS verdict FROM j""")
def complexion_verdict(spark, read):
    d = folds.event_days(read("events"))
    return d.select("subject_id", "day", service.judge_complexion(F.col("x"), F.col("n_purchase") > 0, F.lit(90.0), F.lit(30.0), F.col("n_events") >= 2).alias("verdict"))


_R = sentences.REPORT
_KIND = "CASE event_type WHEN 'purchase' THEN '음주' WHEN 'signup' THEN '카페인' ELSE '운동(달리기)' END"


@query(f"""WITH k AS (SELECT user_id, {_KIND} AS reason, count(*) AS n, median(value) AS m FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1, 2),
s AS (SELECT user_id, list(printf('{_R["reason"]}', CASE reason WHEN '음주' THEN '음주가' WHEN '카페인' THEN '카페인이' ELSE '운동(달리기)이' END, '아침', CAST(round_even(coalesce(m, 0), 0) AS BIGINT), n) ORDER BY reason) AS reasons, sum(n) AS given FROM k GROUP BY 1),
u AS (SELECT user_id, count(*) AS records, count(*) FILTER (event_type = 'purchase' AND value > 150) AS red, count(*) FILTER (event_type = 'click' AND value > 180) AS open,
  list(DISTINCT strftime(ts, '%m/%d')) FILTER (event_type = 'click' AND value > 180) AS days, min(CAST(ts AS DATE)) FILTER (event_type = 'view' AND value > 100) AS back FROM events GROUP BY 1)
SELECT u.user_id, list_concat([printf('{_R["records"]}', records, coalesce(CAST(given AS BIGINT), 0))], coalesce(reasons, []), CASE WHEN red > 0 THEN [printf('{_R["redness"]}', red)] ELSE [] END,
  [CASE WHEN open > 0 THEN printf('{_R["unexplained"]}', open, list_aggregate(list_sort(days), 'string_agg', ', ')) ELSE '{_R["all_explained"]}' END,
   CASE WHEN back IS NOT NULL THEN printf('{_R["recovered"]}', strftime(back, '%m/%d')) ELSE '{_R["not_recovered"]}' END]) AS sentences FROM u LEFT JOIN s ON u.user_id = s.user_id""")
def exam_report(spark, read):
    """A report for each user: what was recorded, why, what stayed open, and when it was over."""
    e = read("events").withColumn("day", F.to_date("ts"))
    kinds = e.where(F.col("event_type").isin(*CAUSE)).groupBy("user_id", lookups.looked_up(F.col("event_type"), CAUSE).alias("reason")).agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("m"))
    why = F.struct("reason", F.array().cast("array<string>").alias("subs"), F.lit("아침").alias("routine"), F.col("m").alias("median_delta"), "n")
    reasons = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(why)).alias("reasons"), F.sum("n").alias("given"))
    open_ = (F.col("event_type") == "click") & (F.col("value") > 180)
    u = e.groupBy("user_id").agg(
        F.count("*").alias("records"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("red"), F.count_if(open_).alias("open"),
        F.collect_set(F.when(open_, F.col("day"))).alias("days"), F.min(F.when((F.col("event_type") == "view") & (F.col("value") > 100), F.col("day"))).alias("back"),
    ).join(reasons, "user_id", "left")
    given, some = F.coalesce("given", F.lit(0)), F.coalesce("reasons", F.array().cast(reasons.schema["reasons"].dataType))
    return u.select("user_id", sentences.report_sentences(F.col("records"), given, some, F.col("red"), F.col("days"), F.col("back"), F.col("open")).alias("sentences"))


_N = sentences.NOTICES


def _notice_sql(part: int) -> str:
    return f"CASE WHEN status = 'ALERT' THEN printf('{_N['ALERT'][part]}', 2) WHEN status = 'ASK' THEN CASE mode WHEN 'early' THEN '{_N['early'][part]}' WHEN 'adapting' THEN '{_N['adapting'][part]}' ELSE '{_N['ASK'][part]}' END END"


@query(f"""WITH RECURSIVE {judgement.ALERTS}, st AS (SELECT subject_id, day, CASE WHEN alert THEN 'ALERT' WHEN deviated AND n_signup > 1 THEN 'ASK' ELSE 'CALM' END AS status, CASE WHEN n_events < 3 THEN 'early' WHEN n_events < 5 THEN 'adapting' END AS mode FROM al)
SELECT subject_id, day, {_notice_sql(0)} AS title, {_notice_sql(1)} AS body FROM st""")
def notice_text(spark, read):
    """The notice that a day's state gives, if any."""
    d = judgement.alert_table(read)
    status = F.when(F.col("alert"), "ALERT").when(F.col("deviated") & (F.col("n_signup") > 1), "ASK").otherwise("CALM")
    mode = F.when(F.col("n_events") < 3, "early").when(F.col("n_events") < 5, "adapting")
    title, body = sentences.notice_text(status, mode, F.lit(2))
    return d.select("subject_id", "day", title.alias("title"), body.alias("body"))


_ARM = judgement._alert_sql("2", ", zt")


@query(f"""WITH RECURSIVE {judgement.CAUSED}, {judgement.VERDICT}, zz AS (SELECT unnest([1.0, 1.25, 1.5, 2.0, 2.5, 99.0]) AS zt),
src AS (SELECT subject_id, day, zt, valid, zt = 99.0 AND held AS held, CASE WHEN zt = 99.0 THEN carried_frac ELSE CAST(coalesce(valid AND z >= zt, false) AS DOUBLE) END AS carried_frac FROM ap, zz), {_ARM},
n AS (SELECT zt, count(*) FILTER (alert) AS n FROM al GROUP BY 1), t AS (SELECT n AS target FROM n WHERE zt = 99.0)
SELECT CAST(zt AS DOUBLE) AS cut, n AS n_alerts, target FROM n, t WHERE zt <> 99.0 ORDER BY abs(n - target), zt LIMIT 1""")
def matched_to_explained(spark, read):
    """The z cut that alerts as often as the explained arm does."""
    v = judgement.verdicts(read)
    return alerts.matched(v.select("subject_id", "day", "valid", "z"), "z", [1.0, 1.25, 1.5, 2.0, 2.5], alerts.alerts(v, 0.5, 2), k=2)
