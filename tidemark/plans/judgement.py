"""Facts, rules, explanation, alerts and their evaluation over `events` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alerts as al
from tidemark.operators import baselines, explain, facts, folds
from tidemark.plans.days import z_table
from tidemark.plans.registry import DAY, Z, query, rounded

# One row per user and day stands for a window: its counts by type are the channels, its label follows from them.
FEATURES = """f AS (SELECT subject_id, day, x AS hr_mean, n_events * 1.0 AS rmssd, n_view * 1.0 AS mean_tonic_eda, n_click * 1.0 AS peaks_density, n_purchase * 0.015 AS acc_dyn_mean,
  CASE WHEN n_purchase >= 2 THEN 'EXERCISE' WHEN n_error >= 1 THEN 'STRESS' ELSE 'REST' END AS label, subject_id % 5 AS fold FROM day)"""
SCORED = f"""{DAY}, {FEATURES},
cut AS (SELECT *, quantile_cont(acc_dyn_mean, 0.5) OVER (PARTITION BY subject_id) AS c FROM f),
p AS (SELECT *, count(*) FILTER (acc_dyn_mean <= c) OVER (PARTITION BY subject_id) AS k FROM cut),
r AS (SELECT *, acc_dyn_mean <= c OR k < 3 AS is_ref FROM p),
st AS (SELECT *, count(*) FILTER (is_ref) OVER w AS kr, {", ".join(f"avg(CASE WHEN is_ref THEN {c} END) OVER w AS m_{c}, stddev_pop(CASE WHEN is_ref THEN {c} END) OVER w AS s_{c}, avg({c}) OVER w AS ma_{c}, stddev_pop({c}) OVER w AS sa_{c}" for c in ("hr_mean", "rmssd", "mean_tonic_eda", "peaks_density"))} FROM r WINDOW w AS (PARTITION BY subject_id)),
sc AS (SELECT subject_id, day, label, fold, acc_dyn_mean AS s_act, {", ".join(f"round(CASE WHEN kr < 3 THEN ({c} - ma_{c}) / coalesce(nullif(sa_{c}, 0), 1) ELSE ({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1) END * {sign}, 6) AS {name}" for c, sign, name in (("hr_mean", 1, "s_hr"), ("rmssd", -1, "s_hrv"), ("mean_tonic_eda", 1, "s_eda"), ("peaks_density", 1, "s_scr")))} FROM st)"""
FACTS = f"""{SCORED}, fa AS (SELECT *, s_hr > 0.5 AS hr, s_hrv > 0.5 AS hrv, s_eda > 0.5 AS eda, s_scr > 0.5 AS scr, s_act > 0.02 AS act, s_act > 0.045 AS vact, s_act < 0.02 AS act_low FROM sc)"""
EVIDENCE = f"""{FACTS}, ev AS (SELECT *, CAST(hr AND act AS DOUBLE) AS r1, CAST(act AND NOT hr AS DOUBLE) AS r2, CAST(vact AS DOUBLE) AS r2b, CAST(hr AND hrv AND eda AND act_low AS DOUBLE) AS r3,
  CAST(hr AND eda AND act_low AS DOUBLE) AS r3b, CAST(scr AND act_low AND NOT hr AS DOUBLE) AS r4, CAST(NOT hr AND NOT act AND NOT eda AS DOUBLE) AS r5 FROM fa),
evi AS (SELECT *, (r1 + 0.6 * r2 + 0.6 * r2b) / 2.2 AS exercise, (r3 + r3b + 0.6 * r4) / 2.6 AS stress, r5 AS rest FROM ev)"""


def features(read):
    d = folds.event_days(read("events"))
    label = F.when(F.col("n_purchase") >= 2, "EXERCISE").when(F.col("n_error") >= 1, "STRESS").otherwise("REST")
    return d.select(
        "subject_id", "day", F.col("x").alias("hr_mean"), (F.col("n_events") * 1.0).cast("double").alias("rmssd"), F.col("n_view").cast("double").alias("mean_tonic_eda"), F.col("n_click").cast("double").alias("peaks_density"),
        (F.col("n_purchase") * F.lit(0.015)).alias("acc_dyn_mean"), label.alias("label"), (F.col("subject_id") % 5).alias("fold"),
    )


def scored(read):
    out = baselines.reference_rows(features(read), activity="acc_dyn_mean")
    for fact, (feature, sign, absolute) in facts.FACTS.items():
        if absolute is None:
            out = baselines.subject_z(out, feature, out="_s").withColumn(f"s_{fact}", F.round(F.col("_s") * sign, 6)).drop("_s")
        else:
            out = out.withColumn(f"s_{fact}", F.col(feature) * sign)
    return out


CUTS = {f: ((0.5, -0.5) if a is None else (a, a)) for f, (_, _, a) in facts.FACTS.items()}


def with_evidence(read):
    return facts.apply_rules(facts.apply_cuts(scored(read), CUTS))


@query(f"WITH {FACTS} SELECT subject_id, day, s_hr, hr, hrv, eda, scr, act, vact, act_low FROM fa", name="facts")
def facts_query(spark, read):
    f = facts.apply_cuts(scored(read), CUTS)
    names = {"s_HR_HIGH": "s_hr", "HR_HIGH": "hr", "HRV_LOW": "hrv", "EDA_HIGH": "eda", "SCR_HIGH": "scr", "ACTIVITY_HIGH": "act", "ACTIVITY_VERY_HIGH": "vact", "ACTIVITY_LOW": "act_low"}
    return f.select("subject_id", "day", *[F.col(a).alias(b) for a, b in names.items()])


@query(f"WITH {EVIDENCE} SELECT subject_id, day, round(exercise, 6) AS exercise, round(stress, 6) AS stress, round(rest, 6) AS rest FROM evi")
def rule_evidence(spark, read):
    e = with_evidence(read)
    return rounded(e.select("subject_id", "day", F.col("EXERCISE_EVIDENCE").alias("exercise"), F.col("STRESS_EVIDENCE").alias("stress"), F.col("REST_EVIDENCE").alias("rest")), "exercise", "stress", "rest")


_RULE_ROWS = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS state, label, {c} > 0 AS fired FROM evi" for r, s, c in (("R1", "EXERCISE", "r1"), ("R2", "EXERCISE", "r2"), ("R2b", "EXERCISE", "r2b"), ("R3", "STRESS", "r3"), ("R3b", "STRESS", "r3b"), ("R4", "STRESS", "r4"), ("R5", "REST", "r5")))


@query(f"""WITH {EVIDENCE}, e AS ({_RULE_ROWS})
SELECT rule, state, count(*) FILTER (fired) AS n_fired, round(count(*) FILTER (fired) / count(*), 6) AS fire_rate,
  round(count(*) FILTER (fired AND label = state) / nullif(count(*) FILTER (fired), 0), 6) AS precision, round(count(*) FILTER (fired AND label = state) / nullif(count(*) FILTER (label = state), 0), 6) AS recall FROM e GROUP BY 1, 2""")
def rule_coverage(spark, read):
    return rounded(facts.rule_coverage(with_evidence(read)), "fire_rate", "precision", "recall")


@query(f"""WITH {FACTS} SELECT label, count(*) AS n, round(avg(CAST(hr AS INT)), 6) AS hr, round(avg(CAST(eda AS INT)), 6) AS eda, round(avg(CAST(act AS INT)), 6) AS act FROM fa GROUP BY 1""")
def fact_rates(spark, read):
    f = facts.apply_cuts(scored(read), CUTS)
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rounded(f.groupBy("label").agg(F.count("*").alias("n"), rate("HR_HIGH").alias("hr"), rate("EDA_HIGH").alias("eda"), rate("ACTIVITY_HIGH").alias("act")), "hr", "eda", "act")


def _grid_sql(grid) -> str:
    return "(SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in grid) + "]) AS cut)"


@query(f"""WITH {SCORED}, t AS (SELECT cut, count(*) AS n, count(*) FILTER (s_hr > cut AND label <> 'REST') AS tp, count(*) FILTER (s_hr > cut AND label = 'REST') AS fp, count(*) FILTER (label <> 'REST') AS np, count(*) FILTER (label = 'REST') AS nn
  FROM sc, {_grid_sql(facts.Z_GRID)} WHERE fold <> 0 GROUP BY 1), j AS (SELECT cut, round(tp / np - fp / nn, 12) AS j FROM t)
SELECT cut, round(j, 6) AS j FROM j ORDER BY j.j DESC, cut LIMIT 1""")
def fit_thresholds_youden(spark, read):
    s = scored(read).where("fold <> 0")
    return rounded(facts.youden(facts.candidates(s, "s_HR_HIGH", F.col("label") != "REST", facts.Z_GRID), [], 0.5), "j").select("cut", "j")


@query(f"""WITH {SCORED}, t AS (SELECT cut, count(*) FILTER (s_act > cut) AS h, count(*) FILTER (s_act > cut AND label = 'EXERCISE') AS tp FROM sc, {_grid_sql(facts.VERY_HIGH_GRID)} WHERE fold <> 0 GROUP BY 1)
SELECT coalesce(min(cut) FILTER (h >= 5 AND tp / h >= 0.85), max(cut)) AS cut FROM t""")
def fit_thresholds_precision(spark, read):
    s = scored(read).where("fold <> 0")
    return facts.precise(facts.candidates(s, "s_ACTIVITY_VERY_HIGH", F.col("label") == "EXERCISE", facts.VERY_HIGH_GRID), [], 0.045).select("cut")


@query(f"""WITH {SCORED}, t AS (SELECT g.fold, cut, count(*) FILTER (s_hr > cut AND label <> 'REST') / count(*) FILTER (label <> 'REST') - count(*) FILTER (s_hr > cut AND label = 'REST') / count(*) FILTER (label = 'REST') AS j
  FROM sc, {_grid_sql(facts.Z_GRID)}, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) g WHERE sc.fold <> g.fold GROUP BY 1, 2),
b AS (SELECT fold, cut, row_number() OVER (PARTITION BY fold ORDER BY round(j, 12) DESC, cut) AS r FROM t)
SELECT subject_id, day, b.cut, s_hr > b.cut AS hr, s_hr < -b.cut AS hr_low FROM sc JOIN b ON sc.fold = b.fold AND r = 1""")
def facts_crossfit(spark, read):
    out = facts.cross_fitted(scored(read), "fold", [0, 1, 2, 3, 4], "HR_HIGH", F.col("label") != "REST", facts.Z_GRID, 0.5)
    return out.select("subject_id", "day", F.col("cut_HR_HIGH").alias("cut"), F.col("HR_HIGH").alias("hr"), F.col("HR_HIGH_LOW").alias("hr_low"))


@query(f"""WITH {DAY}, {FEATURES}, g AS (SELECT z.cut AS hi, a.cut AS act FROM {_grid_sql([0.0, 0.5, 1.0])} z, {_grid_sql(facts.ACTIVITY_GRID)} a), s AS (SELECT *, acc_dyn_mean AS s_act FROM f)
SELECT hi, act, count(*) FILTER (s_act > act) AS n_active, count(*) FILTER (s_act > act AND hr_mean > 50 * (1 + hi)) AS n_both FROM s, g GROUP BY 1, 2""")
def threshold_sweep(spark, read):
    grid = F.array(*[F.struct(F.lit(h).alias("hi"), F.lit(a).alias("act")) for h in (0.0, 0.5, 1.0) for a in facts.ACTIVITY_GRID])
    s = features(read).select("hr_mean", "acc_dyn_mean", F.inline(grid))
    active = F.col("acc_dyn_mean") > F.col("act")
    return s.groupBy("hi", "act").agg(F.count_if(active).alias("n_active"), F.count_if(active & (F.col("hr_mean") > 50 * (1 + F.col("hi")))).alias("n_both"))


PRED = """pr AS (SELECT *, CASE WHEN s_act > 0.02 THEN 'EXERCISE' WHEN s_hr > 0.8 THEN 'STRESS' ELSE 'REST' END AS pred_label, 0.5 + least(abs(s_hr), 1.0) * 0.5 AS confidence FROM evi),
ow AS (SELECT *, CASE pred_label WHEN 'REST' THEN rest WHEN 'STRESS' THEN stress ELSE exercise END AS own_evidence,
  greatest(CASE WHEN pred_label <> 'REST' THEN rest ELSE -1 END, CASE WHEN pred_label <> 'STRESS' THEN stress ELSE -1 END, CASE WHEN pred_label <> 'EXERCISE' THEN exercise ELSE -1 END) AS rival_evidence FROM pr),
ri AS (SELECT *, CASE WHEN pred_label <> 'REST' AND rest = rival_evidence THEN 'REST' WHEN pred_label <> 'STRESS' AND stress = rival_evidence THEN 'STRESS' ELSE 'EXERCISE' END AS rival_label FROM ow),
au AS (SELECT *, CASE WHEN rival_evidence - own_evidence > 0.3 THEN 'CONFLICT' WHEN own_evidence >= 0.5 THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS audit FROM ri),
co AS (SELECT *, audit <> 'SUPPORTED' AS flag, confidence < 0.75 AND rival_evidence - own_evidence > 0.3 AND rival_evidence >= 0.5 AS was_corrected FROM au),
cr AS (SELECT *, CASE WHEN was_corrected THEN rival_label ELSE pred_label END AS corrected_label FROM co)"""


def audited(read):
    e = with_evidence(read)
    pred = F.when(F.col("s_ACTIVITY_HIGH") > 0.02, "EXERCISE").when(F.col("s_HR_HIGH") > 0.8, "STRESS").otherwise("REST")
    e = e.withColumn("pred_label", pred).withColumn("confidence", 0.5 + F.least(F.abs("s_HR_HIGH"), F.lit(1.0)) * 0.5)
    return facts.correct(facts.audit(e))


@query(f"WITH {EVIDENCE}, {PRED} SELECT subject_id, day, pred_label, round(own_evidence, 6) AS own_evidence, round(rival_evidence, 6) AS rival_evidence, rival_label, audit, flag FROM cr")
def audit(spark, read):
    a = audited(read).select("subject_id", "day", "pred_label", "own_evidence", "rival_evidence", "rival_label", "audit", "flag")
    return rounded(a, "own_evidence", "rival_evidence")


@query(f"WITH {EVIDENCE}, {PRED} SELECT subject_id, day, was_corrected, corrected_label FROM cr")
def correction(spark, read):
    return audited(read).select("subject_id", "day", "was_corrected", "corrected_label")


@query(f"""WITH {EVIDENCE}, {PRED}, l AS (SELECT count(*) FILTER (was_corrected) AS n_corrected, count(*) FILTER (was_corrected AND pred_label <> label AND corrected_label = label) AS fixed,
  count(*) FILTER (was_corrected AND pred_label = label AND corrected_label <> label) AS broken, count(*) FILTER (was_corrected AND pred_label <> label AND corrected_label <> label) AS moved_still_wrong FROM cr)
SELECT *, fixed - broken AS net_gain, round(fixed / nullif(n_corrected, 0), 6) AS correction_precision FROM l""")
def correction_ledger(spark, read):
    return rounded(facts.correction_ledger(audited(read)), "correction_precision")


@query(f"""WITH {EVIDENCE}, {PRED} SELECT label, count(*) FILTER (audit = 'SUPPORTED') AS supported, count(*) FILTER (audit = 'UNCERTAIN') AS uncertain, count(*) FILTER (audit = 'CONFLICT') AS conflict FROM cr GROUP BY 1""")
def audit_breakdown(spark, read):
    kinds = ["SUPPORTED", "UNCERTAIN", "CONFLICT"]
    return audited(read).groupBy("label").pivot("audit", kinds).count().na.fill(0).withColumnsRenamed({k: k.lower() for k in kinds})


@query(f"""WITH {EVIDENCE}, t AS (SELECT *, CASE WHEN NOT s_hr > 0.5 THEN 'NOT_DEVIATING' WHEN stress >= 0.3 AND stress - exercise > 0.15 THEN 'EXPLAINED_STRESS' WHEN exercise >= 0.3 AND exercise - stress > 0.15 THEN 'EXPLAINED_EXERCISE' ELSE 'UNEXPLAINED' END AS tag FROM evi)
SELECT subject_id, day, CASE WHEN tag = 'EXPLAINED_EXERCISE' AND s_hr > 2.0 THEN 'EXCEEDS_EXPLANATION' ELSE tag END AS tag, tag = 'UNEXPLAINED' OR (tag = 'EXPLAINED_EXERCISE' AND s_hr > 2.0) AS carried FROM t""")
def explain_tags(spark, read):
    e = with_evidence(read).withColumn("deviation", F.col("s_HR_HIGH"))
    out = explain.explain_tags(e, 0.5, {"EXPLAINED_EXERCISE": 2.0, "EXPLAINED_STRESS": None}, least=0.3)
    return out.select("subject_id", "day", "tag", explain.carried_forward(F.col("tag")).alias("carried"))


CAUSED = f"""{Z}, ca AS (SELECT *, coalesce(datediff('day', lag(day) OVER w, day) = 1 AND lag(n_purchase) OVER w > 0, false) AS exercise, n_signup > 0 AS sleep_debt, subject_id % 5 AS fold FROM z WINDOW w AS (PARTITION BY subject_id ORDER BY day))"""


def caused(read):
    z = z_table(read)
    flag = baselines.previous_day_flag(z, F.col("n_purchase") > 0)
    return z.withColumn("exercise", flag).withColumn("sleep_debt", F.col("n_signup") > 0).withColumn("fold", F.col("subject_id") % 5)


@query(f"""WITH {CAUSED} SELECT round(CASE WHEN count(z) FILTER (exercise AND valid) >= 20 THEN quantile_cont(z, 0.95) FILTER (exercise AND valid) END, 6) AS cap_exercise, count(z) FILTER (exercise AND valid) AS n_exercise,
  round(CASE WHEN count(z) FILTER (sleep_debt AND valid) >= 20 THEN quantile_cont(z, 0.95) FILTER (sleep_debt AND valid) END, 6) AS cap_sleep_debt, count(z) FILTER (sleep_debt AND valid) AS n_sleep_debt FROM ca WHERE fold <> 0""")
def cause_ceiling(spark, read):
    d = caused(read).where("fold <> 0")
    return rounded(explain.cause_ceilings(d, {c: F.col(c) & F.col("valid") for c in explain.CAUSES}, "z"), "cap_exercise", "cap_sleep_debt")


_STEPS = ", ".join(str(round(0.05 + 0.025 * k, 3)) for k in range(37))


@query(f"""WITH {SCORED}, tr AS (SELECT s_hr, label <> 'REST' AS y FROM sc WHERE fold <> 0),
g AS (SELECT DISTINCT round(unnest(quantile_cont(s_hr, [{_STEPS}])), 9) AS cut FROM tr),
t AS (SELECT cut, round(count(*) FILTER (s_hr > cut AND y) / count(*) FILTER (y) - count(*) FILTER (s_hr > cut AND NOT y) / count(*) FILTER (NOT y), 12) AS j FROM tr, g GROUP BY 1)
SELECT round(cut, 6) AS cut, round(j, 6) AS j FROM t ORDER BY t.j DESC, t.cut LIMIT 1""")
def dev_threshold(spark, read):
    s = scored(read).where("fold <> 0")
    grid = s.agg(F.percentile("s_HR_HIGH", F.array(*[F.lit(round(0.05 + 0.025 * k, 3)) for k in range(37)])).alias("g")).first()["g"]  # 37 numbers
    grid = sorted({round(g, 9) for g in grid})
    return rounded(facts.youden(facts.candidates(s, "s_HR_HIGH", F.col("label") != "REST", grid), [], 0.0), "cut", "j").select("cut", "j")


VERDICT = """ex AS (SELECT *, coalesce(valid AND z >= 1.0, false) AS deviated FROM ca),
eb AS (SELECT *, CASE WHEN NOT deviated THEN '' WHEN exercise AND z <= 3.0 THEN 'exercise' WHEN sleep_debt THEN 'sleep_debt' ELSE '' END AS explained_by FROM ex),
ap AS (SELECT *, CAST(deviated AND explained_by = '' AS DOUBLE) AS carried_frac, deviated AND explained_by <> '' AS held FROM eb)"""


def verdicts(read):
    return explain.apply_explanation(caused(read), "z", 1.0, {"exercise": 3.0})


@query(f"WITH {CAUSED}, {VERDICT} SELECT subject_id, day, deviated, explained_by, carried_frac, held FROM ap")
def apply_explanation(spark, read):
    return verdicts(read).select("subject_id", "day", "deviated", "explained_by", "carried_frac", "held")


@query(f"""WITH {CAUSED}, caps AS (SELECT g.fold, CASE WHEN count(z) FILTER (exercise AND valid) >= 20 THEN quantile_cont(z, 0.95) FILTER (exercise AND valid) END AS ce, CASE WHEN count(z) FILTER (sleep_debt AND valid) >= 20 THEN quantile_cont(z, 0.95) FILTER (sleep_debt AND valid) END AS cs
  FROM ca, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) g WHERE ca.fold <> g.fold GROUP BY 1),
e AS (SELECT ca.*, ce, cs, coalesce(valid AND z >= 1.0, false) AS deviated FROM ca JOIN caps USING (fold)),
b AS (SELECT *, CASE WHEN NOT deviated THEN '' WHEN exercise AND coalesce(z <= ce, true) THEN 'exercise' WHEN sleep_debt AND coalesce(z <= cs, true) THEN 'sleep_debt' ELSE '' END AS explained_by FROM e)
SELECT subject_id, day, round(ce, 6) AS cap_exercise, explained_by, CAST(deviated AND explained_by = '' AS DOUBLE) AS carried_frac, deviated AND explained_by <> '' AS held FROM b""")
def crossfit_explanation(spark, read):
    out = explain.crossfit_explanation(caused(read), "fold", 5, limit=1.0)
    return rounded(out.select("subject_id", "day", "cap_exercise", "explained_by", "carried_frac", "held"), "cap_exercise")


@query(f"""WITH {CAUSED}, k AS (SELECT subject_id, cause, z FROM (SELECT subject_id, z, valid, unnest([CASE WHEN exercise THEN 'e' END, CASE WHEN sleep_debt THEN 's' END]) AS cause FROM ca) WHERE cause IS NOT NULL AND valid AND z IS NOT NULL),
caps AS (SELECT s.subject_id, cause, CASE WHEN count(*) >= 20 THEN quantile_cont(z, 0.95) END AS cap FROM (SELECT DISTINCT subject_id FROM ca) s JOIN k ON k.subject_id <> s.subject_id GROUP BY 1, 2),
e AS (SELECT ca.*, a.cap AS ce, b.cap AS cs, coalesce(valid AND z >= 1.0, false) AS deviated FROM ca LEFT JOIN caps a ON a.subject_id = ca.subject_id AND a.cause = 'e' LEFT JOIN caps b ON b.subject_id = ca.subject_id AND b.cause = 's'),
b AS (SELECT *, CASE WHEN NOT deviated THEN '' WHEN exercise AND coalesce(z <= ce, true) THEN 'exercise' WHEN sleep_debt AND coalesce(z <= cs, true) THEN 'sleep_debt' ELSE '' END AS explained_by FROM e)
SELECT subject_id, day, round(ce, 6) AS cap_exercise, round(cs, 6) AS cap_sleep_debt, explained_by FROM b""")
def crossfit_each_subject(spark, read):
    """Ceilings that all the other subjects set, every subject a fold of its own."""
    out = explain.crossfit_explanation(caused(read), "subject_id", limit=1.0)
    return rounded(out.select("subject_id", "day", "cap_exercise", "cap_sleep_debt", "explained_by"), "cap_exercise", "cap_sleep_debt")


@query(f"""WITH {SCORED}, t AS (SELECT g.subject_id, cut, count(*) AS n, count(*) FILTER (label <> 'REST') AS np, count(*) FILTER (label = 'REST') AS nn, count(*) FILTER (s_hr > cut AND label <> 'REST') AS tp, count(*) FILTER (s_hr > cut AND label = 'REST') AS fp
  FROM sc, {_grid_sql(facts.Z_GRID)}, (SELECT DISTINCT subject_id FROM sc) g WHERE sc.subject_id <> g.subject_id AND s_hr IS NOT NULL GROUP BY 1, 2),
j AS (SELECT *, round(tp / np - fp / nn, 12) AS j FROM t WHERE n >= 10 AND np > 0 AND nn > 0), b AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY j DESC, cut) AS r FROM j)
SELECT sc.subject_id, day, coalesce(b.cut, 0.5) AS cut, coalesce(s_hr > coalesce(b.cut, 0.5), false) AS hr FROM sc LEFT JOIN b ON sc.subject_id = b.subject_id AND r = 1""")
def facts_each_subject(spark, read):
    """A fact whose cut all the other subjects fit, every subject a fold of its own."""
    out = facts.cross_fitted(scored(read), "subject_id", None, "HR_HIGH", F.col("label") != "REST", facts.Z_GRID, 0.5)
    return out.select("subject_id", "day", F.col("cut_HR_HIGH").alias("cut"), F.col("HR_HIGH").alias("hr"))


def _alert_sql(k: str = "2", more: str = "", refractory: int = 7) -> str:
    keys = "subject_id" + more
    return f"""g AS (SELECT *, datediff('day', lag(day) OVER w, day) AS gap, carried_frac >= 0.5 AND valid AS unresolved, valid AND NOT held AS judged FROM src WINDOW w AS (PARTITION BY {keys} ORDER BY day)),
i AS (SELECT *, sum(CAST(coalesce(gap > 2, false) OR (judged AND NOT unresolved) AS INT)) OVER (PARTITION BY {keys} ORDER BY day) AS island FROM g),
u AS (SELECT *, CASE WHEN judged AND unresolved THEN sum(CAST(judged AND unresolved AS INT)) OVER (PARTITION BY {keys}, island ORDER BY day) ELSE 0 END AS run_len FROM i),
cand AS (SELECT {keys}, day FROM u WHERE judged AND run_len >= {k}),
nx AS (SELECT {", ".join(f"a.{c}" for c in keys.split(", "))}, a.day, min(b.day) AS nday FROM cand a LEFT JOIN cand b ON {" AND ".join(f"a.{c} = b.{c}" for c in keys.split(", "))} AND b.day >= a.day + {refractory} GROUP BY ALL),
fired AS (SELECT {keys}, min(day) AS day FROM cand GROUP BY {keys} UNION ALL SELECT {", ".join(f"f.{c}" for c in keys.split(", "))}, nx.nday FROM fired f JOIN nx ON {" AND ".join(f"f.{c} = nx.{c}" for c in keys.split(", "))} AND f.day = nx.day WHERE nx.nday IS NOT NULL),
al AS (SELECT u.*, fired.day IS NOT NULL AS alert FROM u LEFT JOIN fired ON {" AND ".join(f"u.{c} = fired.{c}" for c in keys.split(", "))} AND u.day = fired.day)"""


ALERTS = f"{CAUSED}, {VERDICT}, src AS (SELECT * FROM ap), {_alert_sql()}"


def alert_table(read):
    return al.alerts(verdicts(read), 0.5, 2)


@query(f"WITH RECURSIVE {ALERTS} SELECT subject_id, day, round(x, 6) AS x, round(z, 6) AS z, deviated, CAST(run_len AS BIGINT) AS run_len, alert FROM al")
def alerts_k(spark, read):
    return rounded(alert_table(read).select("subject_id", "day", "x", "z", "deviated", "run_len", "alert"), "x", "z")


def _eval_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f"AND a.{keys} = m.{keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""evd AS (SELECT DISTINCT subject_id, day FROM day WHERE n_error >= 2),
ne AS (SELECT count(*) AS n_events FROM evd),
fa2 AS (SELECT {k}subject_id, day FROM al WHERE alert AND valid),
hit AS (SELECT DISTINCT {f"f.{keys}, " if keys else ""}e.subject_id, e.day FROM evd e JOIN fa2 f ON e.subject_id = f.subject_id AND f.day BETWEEN e.day - 1 AND e.day + 2),
mat AS (SELECT DISTINCT {f"f.{keys}, " if keys else ""}f.subject_id, f.day FROM fa2 f JOIN evd e ON e.subject_id = f.subject_id AND e.day BETWEEN f.day - 2 AND f.day + 1),
tot AS (SELECT {k}count(*) AS observed_days, count(*) FILTER (alert) AS n_alerts FROM al WHERE valid {group}),
res AS (SELECT t.*, n_events, (SELECT count(*) FROM hit m {f"WHERE m.{keys} = t.{keys}" if keys else ""}) AS n_detected, (SELECT count(*) FROM mat m {f"WHERE m.{keys} = t.{keys}" if keys else ""}) AS n_matched FROM tot t, ne)
SELECT {k}observed_days, n_alerts, round(n_alerts / (observed_days / 30.4375), 6) AS alerts_per_person_month, n_events, n_detected, round(n_detected / nullif(n_events, 0), 6) AS detection_rate, n_matched, round(n_matched / nullif(n_alerts, 0), 6) AS alert_precision FROM res"""


RATES = ("alerts_per_person_month", "detection_rate", "alert_precision")


def events_of(read):
    return folds.event_days(read("events")).where("n_error >= 2")


@query(f"WITH RECURSIVE {ALERTS}, {_eval_sql()}")
def alert_eval(spark, read):
    return rounded(al.evaluate(alert_table(read), events_of(read), 1, 2), *RATES)


SWEEP = f"{CAUSED}, {VERDICT}, src AS (SELECT ap.*, kk.k FROM ap, (SELECT unnest([1, 2, 3]) AS k) kk), {_alert_sql('k', ', k')}"


@query(f"WITH RECURSIVE {SWEEP}, {_eval_sql('k').replace('SELECT k, observed_days, n_alerts, round', 'SELECT CAST(k AS BIGINT) AS k, observed_days, n_alerts, round')}")
def k_sweep(spark, read):
    return rounded(al.sweep(verdicts(read), events_of(read), [1, 2, 3], 1, 2, limit=0.5), *RATES)


@query(f"""WITH RECURSIVE {CAUSED}, zz AS (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS zt),
src AS (SELECT subject_id, day, zt, valid, false AS held, CAST(coalesce(valid AND z >= zt, false) AS DOUBLE) AS carried_frac FROM ca, zz), {_alert_sql('2', ', zt')},
n AS (SELECT zt, count(*) FILTER (alert) AS n_alerts FROM al GROUP BY 1)
SELECT CAST(zt AS DOUBLE) AS zt, n_alerts FROM n ORDER BY abs(n_alerts - 60), zt LIMIT 1""")
def matched_alerts(spark, read):
    """The z cut whose number of alerts is nearest to a given number: the grid is judged in one plan."""
    d = caused(read).select("subject_id", "day", "valid", "z").withColumn("zt", F.explode(F.array(*[F.lit(v) for v in (0.5, 1.0, 1.5, 2.0)])))
    d = d.withColumn("carried_frac", F.coalesce(F.col("valid") & (F.col("z") >= F.col("zt")), F.lit(False)).cast("double"))
    n = al.alerts(d, 0.5, 2, hold=None, keys=("subject_id", "zt")).groupBy("zt").agg(F.count_if("alert").alias("n_alerts"))
    return n.orderBy(F.abs(F.col("n_alerts") - 60), "zt").limit(1)


@query()
def chance_level(spark, read):
    """Alert days drawn anew within each subject, 2,000 times."""
    return al.chance_level(alert_table(read), events_of(read), 2000, 0, 1, 2)


@query()
def chance_summary(spark, read):
    """What the alerts detect, beside 2,000 draws by chance."""
    return rounded(al.chance_summary(alert_table(read), events_of(read), 1, 2, n_perm=2000), "detection_rate", "alert_precision", "chance_detection_rate", "chance_alert_precision", digits=4)


@query()
def random_drop(spark, read):
    """As many deviating days held at random as the explanation holds."""
    v = verdicts(read)
    n = v.groupBy("subject_id").agg(F.count_if("held").alias("n_drop"))
    return explain.drop_at_random(v.join(n, "subject_id"), "n_drop").select("subject_id", "day", "carried_raw", "random_carried", "random_held")


@query(f"""WITH {CAUSED}, r AS (SELECT *, avg(z) OVER w3 AS z3, sum(CAST(coalesce(z >= 1.0, false) AS INT)) OVER w3 AS d3 FROM ca WINDOW w3 AS (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, 1 / (1 + exp(-(greatest(-5.0, least(10.0, z)) * 0.1179 + z3 * 0.25 + d3 * 0.207 - 0.2371))) AS p FROM r WHERE z IS NOT NULL)
SELECT subject_id, day, round(p, 6) AS p, CASE WHEN p >= 0.7647 THEN 3 WHEN p >= 0.7343 THEN 2 WHEN p >= 0.6222 THEN 1 ELSE 0 END AS level FROM p""")
def risk_score(spark, read):
    from pyspark.sql import Window

    from tidemark.functions import scores

    w = Window.partitionBy("subject_id").orderBy("day").rowsBetween(-2, 0)
    d = caused(read).withColumn("z3", F.avg("z").over(w)).withColumn("d3", F.sum(F.coalesce(F.col("z") >= 1.0, F.lit(False)).cast("int")).over(w)).where("z is not null")
    d = d.withColumn("p", scores.risk_probability(F.col("z"), F.col("z3"), F.col("d3"))).withColumn("level", scores.risk_level(F.col("p")))
    return rounded(d.select("subject_id", "day", "p", "level"), "p")
