"""Explaining deviations by known context, and the ceilings up to which a cause explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranges
from tidemark.operators.baselines import previous_day_flag, rolling_quantile
from tidemark.session import written

CAUSES = ("exercise", "sleep_debt")


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def explain_tags(df: DataFrame, limit: Column | float, ceilings: dict[str, float | None] | None = None, dev: str = "deviation", least: float = 0.5, margin: float = 0.15) -> DataFrame:
    """`df` with a tag: NOT_DEVIATING, UNEXPLAINED, EXPLAINED_EXERCISE, EXPLAINED_STRESS or EXCEEDS_EXPLANATION."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    ex, st = F.col("EXERCISE_EVIDENCE"), F.col("STRESS_EVIDENCE")
    tag = (
        F.when(~true(F.col(dev) > limit), "NOT_DEVIATING")
        .when(true((st >= least) & (st - ex > margin)), "EXPLAINED_STRESS")
        .when(true((ex >= least) & (ex - st > margin)), "EXPLAINED_EXERCISE")
        .otherwise("UNEXPLAINED")
    )
    out = df.withColumn("tag", tag)
    for cause, cap in (ceilings or {}).items():
        if cap is not None:
            out = out.withColumn("tag", F.when((F.col("tag") == cause) & (F.col(dev) > cap), "EXCEEDS_EXPLANATION").otherwise(F.col("tag")))
    return out


def carried_forward(tag: Column) -> Column:
    return tag.isin("UNEXPLAINED", "EXCEEDS_EXPLANATION")


def cause_ceilings(df: DataFrame, causes: dict[str, Column], value: str, q: float = 0.95, min_n: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """-> (keys, cap_<cause>, n_<cause>): the quantile of the value under each cause; NULL below min_n rows."""
    aggs = []
    for c, cond in causes.items():
        v = F.when(cond, F.col(value))
        aggs += [F.when(F.count(v) >= min_n, F.percentile(v, F.lit(q))).alias(f"cap_{c}"), F.count(v).alias(f"n_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def day_causes(df: DataFrame, active: str = "very_active", asleep: str = "asleep", active_q: float = 0.9, active_min: float = 30, sleep_q: float = 0.1, sleep_min: float = 360) -> DataFrame:
    """`df` with exercise (yesterday's activity was high for the subject or at all) and sleep_debt."""
    out = rolling_quantile(df, active, active_q, out="_active_hi")
    out = rolling_quantile(out, asleep, sleep_q, out="_sleep_lo")
    high = (true(F.col(active) >= F.col("_active_hi")) | true(F.col(active) >= active_min)) & true(F.col(active) > 0)
    out = out.withColumn("_was_active", high).withColumn("exercise", previous_day_flag(out, F.col("_was_active")))
    short = true(F.col(asleep) <= F.col("_sleep_lo")) | true(F.col(asleep) < sleep_min)
    return out.withColumn("sleep_debt", F.col(asleep).isNotNull() & short).drop("_active_hi", "_sleep_lo", "_was_active")


def apply_explanation(df: DataFrame, z: str = "z", limit: float = 2.0, caps: dict[str, Column | float | None] | None = None, causes: tuple[str, ...] = CAUSES, valid: str = "valid") -> DataFrame:
    """`df` with deviated, explained_by (the first cause that counts), carried_frac, carried_raw and held."""
    caps = caps or {}
    deviated = true(F.col(valid)) & true(F.col(z) >= limit)
    counts = {}
    for c in causes:
        cap = caps.get(c)
        within = F.lit(True) if cap is None else (F.coalesce(F.col(z) <= cap, F.lit(cap is None) if not isinstance(cap, Column) else cap.isNull()))
        counts[c] = true(F.col(c)) & within
    by = F.coalesce(*[F.when(cond, F.lit(c)) for c, cond in counts.items()], F.lit(""))
    out = df.withColumn("deviated", deviated).withColumn("explained_by", F.when(F.col("deviated"), by).otherwise(""))
    explained = F.col("explained_by") != ""
    return out.withColumns({"carried_frac": (F.col("deviated") & ~explained).cast("double"), "carried_raw": F.col("deviated").cast("double"), "held": F.col("deviated") & explained})


def others_quantile(rows: DataFrame, group: str, fold: str, value: str, q: float = 0.95, min_n: int = 20) -> DataFrame:
    """Rows (group, fold, value) -> (group, fold, cap, n) for each fold of the group: the quantile of the values of all its other folds, NULL
    below min_n of them, and how many there are. No row meets a fold that is not its own, so every subject may be a fold.

    Equal values of a fold are one block, which starts after `_a` values of the group and `_b` of its own fold: `_a - _b` of the others lie
    before it. The k-th of the others is therefore the (k + c)-th of all, c being the fold's values with fewer than k others before
    them. Ranks are counted within ranges between quantiles and added up over ranges, so that no task orders a whole group.
    """
    known = written(rows.where(F.col(value).isNotNull()).groupBy(group, fold, value).agg(F.count("*").alias("_m")))
    blocks = known.withColumn("_r", ranges.range_of(F.col(value), ranges.bounds(known, value)))

    def start(keys: list[str], out: str) -> DataFrame:
        """(keys, _r, how many of the keys' values lie in the ranges before it)."""
        before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        return blocks.groupBy(*keys, "_r").agg(F.sum("_m").alias("_n")).withColumn(out, F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")

    within = lambda keys, order: F.coalesce(F.sum("_m").over(Window.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.withColumn("_ia", within([group], [value, fold])).withColumn("_ib", within([group, fold], [value]))
    ranked = ranked.join(start([group], "_oa"), [group, "_r"]).join(start([group, fold], "_ob"), [group, fold, "_r"])
    ranked = written(ranked.select(group, fold, value, "_m", (F.col("_oa") + F.col("_ia")).alias("_a"), (F.col("_ob") + F.col("_ib")).alias("_b")))

    own = ranked.groupBy(group, fold).agg(F.sum("_m").alias("_own"))
    n = own.join(own.groupBy(group).agg(F.sum("_own").alias("_all")), group).select(group, fold, (F.col("_all") - F.col("_own")).alias("n"))
    at = (F.col("n") - 1) * F.lit(q)
    n = n.withColumn("_lo", F.floor(at) + 1).withColumn("_hi", F.ceil(at) + 1).withColumn("_share", at - F.floor(at))
    fewer = lambda k: F.sum(F.when(F.col("_a") - F.col("_b") < F.col(k), F.col("_m")).otherwise(0))
    places = ranked.join(n, [group, fold]).groupBy(group, fold).agg((F.first("_lo") + fewer("_lo")).alias("_lo"), (F.first("_hi") + fewer("_hi")).alias("_hi"))
    wanted = places.select(group, fold, F.inline(F.array(F.struct(F.lit("_zlo").alias("_which"), F.col("_lo").alias("_rank")), F.struct(F.lit("_zhi").alias("_which"), F.col("_hi").alias("_rank")))))
    # blocks that hold a wanted rank, found by equal rank: only the ranks between the least and the largest wanted are listed
    span = wanted.groupBy(group).agg(F.min("_rank").alias("_from"), F.max("_rank").alias("_to"))
    near = ranked.join(span, group).where((F.col("_a") < F.col("_to")) & (F.col("_a") + F.col("_m") >= F.col("_from")))
    listed = near.select(group, value, F.explode(F.sequence(F.greatest(F.col("_a") + 1, F.col("_from")), F.least(F.col("_a") + F.col("_m"), F.col("_to")))).alias("_rank"))
    found = wanted.join(listed, [group, "_rank"]).groupBy(group, fold).agg(*[F.max(F.when(F.col("_which") == c, F.col(value))).alias(c) for c in ("_zlo", "_zhi")])
    cap = F.col("_zlo") * (1 - F.col("_share")) + F.col("_zhi") * F.col("_share")
    return n.join(found, [group, fold], "left").select(group, fold, F.when(F.col("n") >= min_n, cap).alias("cap"), "n")


def crossfit_explanation(df: DataFrame, fold: str, folds: int | None = None, z: str = "z", limit: float = 2.0, causes: tuple[str, ...] = CAUSES, q: float = 0.95, min_n: int = 20) -> DataFrame:
    """`df` explained with ceilings that only the other folds' rows set; all folds at once.

    A handful of `folds`, numbered from 0, repeat each row for the others in one aggregate. Without their number there may be any
    folds, say one a subject: their ceilings come by rank (others_quantile). A fold without a row of a cause is judged by all
    rows of that cause.
    """
    known = true(F.col("valid")) & F.col(z).isNotNull()
    if folds is not None:
        others = df.withColumn("_for", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col(fold) != F.col("_for"))
        caps = cause_ceilings(others, {c: known & true(F.col(c)) for c in causes}, z, q, min_n, ("_for",))
        caps = F.broadcast(caps.select(F.col("_for").cast("bigint").alias(fold), *[f"cap_{c}" for c in causes]))  # one row a fold
        return apply_explanation(df.join(caps, fold, "left"), z, limit, {c: F.col(f"cap_{c}") for c in causes}, causes)
    under = F.array_compact(F.array(*[F.when(known & true(F.col(c)), F.lit(c)) for c in causes]))
    rows = df.where(F.col(fold).isNotNull()).select(F.col(fold).alias("_fold"), F.col(z).cast("double").alias("_z"), F.explode(under).alias("_cause"))
    caps = others_quantile(rows, "_cause", "_fold", "_z", q, min_n)
    per_fold = caps.groupBy("_fold").agg(*[x for c in causes for x in (F.max(F.when(F.col("_cause") == c, F.col("cap"))).alias(f"_cap_{c}"), F.max(F.when(F.col("_cause") == c, F.col("n"))).alias(f"_n_{c}"))])
    whole = cause_ceilings(df, {c: known & true(F.col(c)) for c in causes}, z, q, min_n).select(*[F.col(f"cap_{c}").alias(f"_whole_{c}") for c in causes])  # one row
    out = df.join(per_fold.withColumnRenamed("_fold", fold), fold, "left").join(F.broadcast(whole), F.lit(True), "left")
    out = out.withColumns({f"cap_{c}": F.when(F.col(f"_n_{c}").isNull(), F.col(f"_whole_{c}")).otherwise(F.col(f"_cap_{c}")) for c in causes})
    return apply_explanation(out.drop(*[f"_{k}_{c}" for c in causes for k in ("cap", "n", "whole")]), z, limit, {c: F.col(f"cap_{c}") for c in causes}, causes)


def drop_at_random(df: DataFrame, n_drop: str, flag: str = "carried_raw", seed: int = 0, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """`df` with random_held and random_carried: of each subject's flagged rows as many as `n_drop` are held, chosen by a seeded hash."""
    order = F.row_number().over(Window.partitionBy(subject, F.col(flag) > 0).orderBy(F.xxhash64(F.lit(seed), subject, day), day))
    held = (F.col(flag) > 0) & (order <= F.col(n_drop))
    return df.withColumn("random_held", held).withColumn("random_carried", F.when(F.col("random_held"), 0.0).otherwise(F.col(flag)))
