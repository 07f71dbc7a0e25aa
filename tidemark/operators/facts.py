"""Facts from scores, thresholds fitted on training rows only, rules and their evidence, audit and correction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Fact -> (feature, direction, absolute cut or None).
FACTS = {
    "HR_HIGH": ("hr_mean", 1, None),
    "HRV_LOW": ("rmssd", -1, None),
    "EDA_HIGH": ("mean_tonic_eda", 1, None),
    "SCR_HIGH": ("peaks_density", 1, None),
    "ACTIVITY_HIGH": ("acc_dyn_mean", 1, 0.020),
    "ACTIVITY_VERY_HIGH": ("acc_dyn_mean", 1, 0.045),
}
#: Candidate cuts.
Z_GRID = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]
ACTIVITY_GRID = [0.010, 0.015, 0.020, 0.030, 0.050]
VERY_HIGH_GRID = [0.030, 0.035, 0.040, 0.045, 0.050, 0.060, 0.070]

#: Rule -> (facts that hold, facts that do not, state, weight, active).
RULES = {
    "R1": (["HR_HIGH", "ACTIVITY_HIGH"], [], "EXERCISE", 1.0, True),
    "R2": (["ACTIVITY_HIGH"], ["HR_HIGH"], "EXERCISE", 0.6, False),
    "R2b": (["ACTIVITY_VERY_HIGH"], [], "EXERCISE", 0.6, True),
    "R3": (["HR_HIGH", "HRV_LOW", "EDA_HIGH", "ACTIVITY_LOW"], [], "STRESS", 1.0, True),
    "R3b": (["HR_HIGH", "EDA_HIGH", "ACTIVITY_LOW"], [], "STRESS", 1.0, True),
    "R4": (["SCR_HIGH", "ACTIVITY_LOW"], ["HR_HIGH"], "STRESS", 0.6, True),
    "R5": ([], ["HR_HIGH", "ACTIVITY_HIGH", "EDA_HIGH"], "REST", 1.0, True),
}
STATES = ("REST", "STRESS", "EXERCISE")


def true(c: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def apply_cuts(df: DataFrame, cuts: dict[str, tuple[Column | float, Column | float]]) -> DataFrame:
    """`df` with <fact> = s_<fact> > high and <fact>_LOW = s_<fact> < low; ACTIVITY_LOW names ACTIVITY_HIGH_LOW."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    new = {}
    for fact, (high, low) in cuts.items():
        s = F.col(f"s_{fact}")
        new[fact], new[f"{fact}_LOW"] = true(s > as_col(high)), true(s < as_col(low))
    if "ACTIVITY_HIGH" in cuts:
        new["ACTIVITY_LOW"] = new["ACTIVITY_HIGH_LOW"]
    return df.withColumns(new)


def candidates(df: DataFrame, score: str, target: Column, grid: list[float], groups: list[Column] | None = None, at_least: bool = False, all_groups: bool = False) -> DataFrame:
    """One row for each cut of the grid (and group): cut, n, tp, fp, n_pos, n_neg. Groups are columns _g0, _g1, ...; with `all_groups` those
    without a known score have rows of zeros.

    Every row meets every cut inside its own task and is added up there: no join, one small shuffle.
    """
    s = F.col(score)
    hit = s >= F.col("_cut") if at_least else s > F.col("_cut")
    rows = (df if all_groups else df.where(s.isNotNull())).withColumn("_known", s.isNotNull())
    known = rows.withColumn("_cut", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn("_pos", true(target))
    names = [f"_g{k}" for k in range(len(groups or []))]
    for name, g in zip(names, groups or [], strict=True):
        known = known.withColumn(name, g)
    pos, neg = F.col("_known") & F.col("_pos"), F.col("_known") & ~F.col("_pos")
    return known.groupBy(*names, "_cut").agg(
        F.count_if("_known").alias("n"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & neg).alias("fp"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg")
    ).withColumnRenamed("_cut", "cut")


def youden(table: DataFrame, keys: list[str], default: float) -> DataFrame:
    """The cut with the largest TPR - FPR, the smallest of equals; the default below 10 rows or with one class only."""
    usable = (F.col("n") >= 10) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    j = F.when(usable, F.round(F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0)) - F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0)), 12))
    best = F.max(F.when(j.isNotNull(), F.struct(j.alias("j"), (-F.col("cut")).alias("c"))))
    return table.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.coalesce(-F.col("_b.c"), F.lit(default)).alias("cut"), F.col("_b.j").alias("j"))


def precise(table: DataFrame, keys: list[str], default: float, least: float = 0.85, hits: int = 5) -> DataFrame:
    """The lowest cut with a precision of `least` on so many hits; else the grid's largest; the default as for youden."""
    usable = (F.col("n") >= 10) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    n = F.col("tp") + F.col("fp")
    good = (n >= hits) & (F.col("tp") / F.nullif(n, F.lit(0)) >= least)
    out = table.groupBy(*keys).agg(F.min(F.when(usable & good, F.col("cut"))).alias("_low"), F.max(F.when(usable, F.col("cut"))).alias("_top"))
    return out.select(*keys, F.coalesce("_low", "_top", F.lit(default)).alias("cut"))


def complement(table: DataFrame, key: str, keys: tuple[str, ...] = ("cut",)) -> DataFrame:
    """Counts of each `key` (and of `keys`) -> the counts of all others: the whole less its own. No row meets another fold."""
    counts = [c for c in table.columns if c not in (key, *keys)]
    return table.withColumns({c: F.sum(c).over(Window.partitionBy(*keys)) - F.col(c) for c in counts})


def cross_fitted(df: DataFrame, fold: str, folds: list | None, fact: str, target: Column, grid: list[float], default: float, absolute: bool = False) -> DataFrame:
    """`df` with <fact> and cut_<fact>: each fold's rows cut by what the other folds' rows fit. All folds at once, as many as there are.

    With `folds`, rows of other folds get the default, as do rows without one. A fold without a known score is cut by all others.
    """
    own = candidates(df, f"s_{fact}", target, grid, [F.col(fold)], all_groups=True)
    # written: a row a fold, whose size Spark then knows, so that it is sent to the rows if it is small and shuffled if not
    cuts = written(youden(complement(own, "_g0"), ["_g0"], default).select(F.col("_g0").alias(fold), F.col("cut").alias("_others")))
    ours = F.col(fold).isin(*folds) if folds is not None else F.col(fold).isNotNull()
    out = df.join(cuts, fold, "left").withColumn(f"cut_{fact}", F.coalesce(F.when(ours, F.col("_others")), F.lit(default))).drop("_others")
    high = F.col(f"cut_{fact}")
    return apply_cuts(out, {fact: (high, high if absolute else -high)})


def rule_fired(rule: str) -> Column:
    yes, no, *_ = RULES[rule]
    return reduce(lambda a, b: a & b, [true(F.col(f)) for f in yes] + [~true(F.col(f)) for f in no])


def apply_rules(df: DataFrame, include_inactive: bool = True) -> DataFrame:
    """`df` with fired_<rule> and <STATE>_EVIDENCE: the weight of the rules that fired over the weight of all, 0 to 1."""
    used = {r: v for r, v in RULES.items() if v[4] or include_inactive}
    out = df.withColumns({f"fired_{r}": rule_fired(r) for r in used})
    evidence = {}
    for state in STATES:
        own = [r for r, v in used.items() if v[2] == state]
        fired = sum((F.col(f"fired_{r}").cast("double") * used[r][3] for r in own), F.lit(0.0))
        evidence[f"{state}_EVIDENCE"] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fired / sum(used[r][3] for r in own)))
    return out.withColumns(evidence)


def rule_coverage(df: DataFrame, label: str = "label", rules: list[str] | None = None) -> DataFrame:
    """-> (rule, state, n_fired, fire_rate, precision, recall) of the fired_<rule> columns against the labels."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][2]).alias("state"), F.col(f"fired_{r}").alias("fired")) for r in rules or RULES])
    each = df.select(label, F.inline(pairs))
    right = F.coalesce(F.col(label) == F.col("state"), F.lit(False))
    counts = each.groupBy("rule", "state").agg(F.count("*").alias("n"), F.count_if("fired").alias("n_fired"), F.count_if(F.col("fired") & right).alias("hits"), F.count_if(right).alias("n_state"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return counts.select("rule", "state", "n_fired", share("n_fired", "n").alias("fire_rate"), share("hits", "n_fired").alias("precision"), share("hits", "n_state").alias("recall"))


def audit(df: DataFrame, pred: str = "pred_label", support: float = 0.5, margin: float = 0.3) -> DataFrame:
    """`df` with own_evidence, rival_evidence, rival_label, audit and flag; of equal rivals the first of STATES."""
    own = F.coalesce(*[F.when(F.col(pred) == s, F.col(f"{s}_EVIDENCE")) for s in STATES], F.lit(0.0))
    others = F.array(*[F.when(~F.coalesce(F.col(pred) == s, F.lit(False)), F.struct(F.col(f"{s}_EVIDENCE").alias("e"), F.lit(-k).alias("k"), F.lit(s).alias("s"))) for k, s in enumerate(STATES)])
    rival = F.array_max(F.filter(others, lambda x: x.isNotNull()))
    out = df.withColumn("own_evidence", own).withColumn("_rival", rival)
    out = out.withColumn("rival_evidence", F.col("_rival.e")).withColumn("rival_label", F.col("_rival.s")).drop("_rival")
    lead = F.col("rival_evidence") - F.col("own_evidence")
    verdict = F.when(lead > margin, "CONFLICT").when(F.col("own_evidence") >= support, "SUPPORTED").otherwise("UNCERTAIN")
    return out.withColumn("audit", verdict).withColumn("flag", F.col("audit") != "SUPPORTED")


def correct(audited: DataFrame, pred: str = "pred_label", confidence: str = "confidence", doubt: float = 0.75, margin: float = 0.3, least: float = 0.5) -> DataFrame:
    """`audited` with was_corrected and corrected_label: an unsure prediction gives way to a clearly better rival."""
    lead = F.col("rival_evidence") - F.col("own_evidence")
    cond = true((F.col(confidence) < doubt) & (lead > margin) & (F.col("rival_evidence") >= least))
    return audited.withColumn("was_corrected", cond).withColumn("corrected_label", F.when(cond, F.col("rival_label")).otherwise(F.col(pred)))


def correction_ledger(df: DataFrame, label: str = "label", pred: str = "pred_label") -> DataFrame:
    """One row: n_corrected, fixed, broken, moved_still_wrong, net_gain, correction_precision."""
    some = F.col("was_corrected")
    before, after = F.col(pred) == F.col(label), F.col("corrected_label") == F.col(label)
    out = df.agg(F.count_if(some).alias("n_corrected"), F.count_if(some & ~before & after).alias("fixed"), F.count_if(some & before & ~after).alias("broken"), F.count_if(some & ~before & ~after).alias("moved_still_wrong"))
    return out.withColumn("net_gain", F.col("fixed") - F.col("broken")).withColumn("correction_precision", F.col("fixed") / F.nullif(F.col("n_corrected"), F.lit(0)))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by `order`."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
