"""Classification and agreement metrics, rank tests, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranges


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """-> (truth, pred, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, pred: str, labels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """-> keys, n_test, accuracy, macro_f1, balanced_accuracy, abstain_rate, f1_<label>; an abstention counts as wrong.

    F1 is 0 where it is undefined; balanced accuracy is the mean recall of the labels present.
    """
    abstain = F.col(pred).isNull() | (F.col(pred) == "UNCERTAIN")
    hit = F.coalesce(~abstain & (F.col(pred) == F.col(truth)), F.lit(False))
    aggs = [F.count("*").alias("n_test"), F.count_if(hit).alias("_hits"), F.count_if(abstain).alias("_abstained")]
    for k, label in enumerate(labels):
        t, p = F.coalesce(F.col(truth) == label, F.lit(False)), F.coalesce((F.col(pred) == label) & ~abstain, F.lit(False))
        aggs += [F.count_if(t & p).alias(f"_tp{k}"), F.count_if(t).alias(f"_t{k}"), F.count_if(p).alias(f"_p{k}")]
    out = df.groupBy(*keys).agg(*aggs)
    f1 = [F.coalesce(_share(2.0 * F.col(f"_tp{k}"), F.col(f"_t{k}") + F.col(f"_p{k}")), F.lit(0.0)) for k in range(len(labels))]
    recalls = F.filter(F.array(*[_share(F.col(f"_tp{k}"), F.col(f"_t{k}")) for k in range(len(labels))]), lambda r: r.isNotNull())
    return out.select(
        *keys, "n_test", _share(F.col("_hits"), F.col("n_test")).alias("accuracy"), (sum(f1, F.lit(0.0)) / len(labels)).alias("macro_f1"),
        (F.aggregate(recalls, F.lit(0.0), lambda a, r: a + r) / F.nullif(F.size(recalls), F.lit(0))).alias("balanced_accuracy"), _share(F.col("_abstained"), F.col("n_test")).alias("abstain_rate"), *[f.alias(f"f1_{label.lower()}") for f, label in zip(f1, labels, strict=True)],
    )


def directional_error(df: DataFrame, truth: str, pred: str, src: str, dst: str) -> Column:
    """Aggregate: share of `src` rows predicted `dst`."""
    return _share(F.count_if((F.col(truth) == src) & (F.col(pred) == dst)), F.count_if(F.col(truth) == src))


def flag_metrics(df: DataFrame, truth: str, pred: str, flag: str) -> DataFrame:
    """One row: flag_precision and flag_recall of a flag for wrong predictions."""
    wrong, flagged = F.col(truth) != F.col(pred), F.col(flag)
    both = F.count_if(wrong & flagged)
    return df.agg(_share(both, F.count_if(flagged)).alias("flag_precision"), _share(both, F.count_if(wrong)).alias("flag_recall"))


def auc(df: DataFrame, score: str, positive: Column, keys: tuple[str, ...] = (), min_n: int = 0) -> DataFrame:
    """-> keys, n_pos, n_neg, auc: exact Mann-Whitney with ties as halves, from counts per distinct score.

    NULL without both classes, or below min_n rows. Without keys the distinct scores are ranked by range buckets, so that
    no task orders them all.
    """
    known = df.where(F.col(score).isNotNull())
    counts = known.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    if not keys:
        counts = counts.withColumn("_b", ranges.range_of(F.col("_s"), ranges.bounds(known, score)))
        inner = Window.partitionBy("_b").orderBy("_s")
        per = counts.groupBy("_b").agg(F.sum("_n").alias("_nb"))  # at most one row a range
        offset = per.withColumn("_off", F.sum("_nb").over(Window.orderBy("_b")) - F.col("_nb")).select("_b", "_off")
        counts = counts.withColumn("_in", F.sum("_n").over(inner) - F.col("_n")).join(F.broadcast(offset), "_b").withColumn("_below", F.col("_in") + F.col("_off"))
    else:
        counts = counts.withColumn("_below", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s")) - F.col("_n"))
    u = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    out = counts.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), u.alias("_u"))
    return out.select(*keys, "n_pos", "n_neg", F.when(F.col("n_pos") + F.col("n_neg") >= min_n, F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def average_rank(value: Column | str, by: Window, all_of: Window) -> Column:
    """Rank from 1, ties averaged. `by` orders, `all_of` is the same partition with the value as a key."""
    return F.rank().over(by) + (F.count("*").over(all_of) - 1) / 2.0


def wilcoxon(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """-> keys, n, n_nonzero, median_diff, r_plus, r_minus, effect_size, p_value.

    p_value is two-sided: exact for at most 50 pairs without ties and zeros, else by the normal approximation, tie-corrected.
    effect_size is the rank-biserial correlation; NULL with p_value below 3 differences. The pairs are one row a
    subject, a small table; with keys they are ranked per key.
    """
    d = df.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d").isNotNull()).withColumn("_size", F.round(F.abs("_d"), 9)).withColumn("_one", F.lit(1))
    part = keys or ("_one",)
    nonzero = d.where(F.col("_size") > 0)
    ranked = nonzero.withColumn("_r", average_rank("_size", Window.partitionBy(*part).orderBy("_size"), Window.partitionBy(*part, "_size")))
    ranked = ranked.withColumn("_t", F.count("*").over(Window.partitionBy(*part, "_size")))
    sums = ranked.groupBy(*part).agg(F.count("*").alias("n_nonzero"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("r_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("r_minus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    whole = d.groupBy(*part).agg(F.count("*").alias("n"), F.percentile("_d", F.lit(0.5)).alias("median_diff"))
    out = whole.join(sums, list(part), "left")
    n = F.col("n_nonzero")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    z = F.abs(F.col("r_plus") - n * (n + 1) / 4.0) / F.sqrt(var)
    enough = n >= 3
    exact = (F.col("_ties") == 0) & (n == F.col("n")) & (n <= 50)
    p = F.when(exact, signed_rank_tail(n, F.least("r_plus", "r_minus"))).otherwise(normal_tail(z))
    return out.select(*keys, "n", F.coalesce(n, F.lit(0)).alias("n_nonzero"), "median_diff", "r_plus", "r_minus", F.when(enough, 2 * F.col("r_plus") / (n * (n + 1) / 2.0) - 1).alias("effect_size"), F.when(enough, p).alias("p_value"))


def signed_rank_tail(n: Column, least: Column) -> Column:
    """Two-sided exact tail of the signed-rank statistic: twice the share of sign patterns whose sum is at most `least`.

    The patterns are counted by their sums, rank after rank: at most n (n + 1) / 2 + 1 counts.
    """
    top = (n * (n + 1) / 2).cast("int")
    first = F.transform(F.sequence(F.lit(0), top), lambda v: F.when(v == 0, 1.0).otherwise(0.0))
    add = lambda acc, r: F.transform(acc, lambda c, v: c + F.when(v >= r, F.get(acc, (v - r).cast("int"))).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), first, add)
    low = F.aggregate(F.slice(counts, F.lit(1), least.cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), n))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal at |z|, by Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5 * poly)


def spearman(df: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    """-> keys, n, rho: Pearson correlation of average ranks within each key."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c, r in ((a, "_ra"), (b, "_rb")):
        known = known.withColumn(r, average_rank(c, Window.partitionBy(*keys).orderBy(c), Window.partitionBy(*keys, c)))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def error_bands(df: DataFrame, truth: str, estimate: str, band: Column, within: float = 5.0) -> DataFrame:
    """-> (band, n, mae, rmse, within) by band."""
    e = F.col(estimate) - F.col(truth)
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.abs(e) <= within).cast("int")).alias("within"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share; NULL for n = 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = hits / m
    mid = p + z * z / (2 * m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (mid - half) / (1 + z * z / m), (mid + half) / (1 + z * z / m)


def paired_effect(df: DataFrame, value: str, on: str, subject: str = "subject_id", least: int = 3) -> DataFrame:
    """-> (subject, n_on, n_off, effect): difference of the medians with and without `on`, where both have enough rows."""
    with_, without = F.when(F.col(on), F.col(value)), F.when(~F.col(on), F.col(value))
    out = df.groupBy(subject).agg(F.count(with_).alias("n_on"), F.count(without).alias("n_off"), (F.percentile(with_, F.lit(0.5)) - F.percentile(without, F.lit(0.5))).alias("effect"))
    return out.where((F.col("n_on") >= least) & (F.col("n_off") >= least))


def group_split(subjects: DataFrame, folds: int, subject: str = "subject_id") -> DataFrame:
    """(subject, fold) by a hash of the subject: stable as subjects are added, and never splits one."""
    return subjects.select(subject).distinct().withColumn("fold", F.pmod(F.xxhash64(F.col(subject).cast("string")), F.lit(folds)).cast("bigint"))


def split_summary(df: DataFrame, subject: str = "subject_id", label: str = "label", fold: str = "fold") -> DataFrame:
    """Rows with a fold -> (fold, n_train, n_test, train_subjects, test_subjects, test_classes, leak), one row a test fold.

    leak: some subject of the fold has rows outside it, so it is trained on too.
    """
    per = df.groupBy(fold, subject).agg(F.count("*").alias("_n"))
    inside = per.withColumn("_folds", F.count("*").over(Window.partitionBy(subject)))
    per_fold = inside.groupBy(fold).agg(F.sum("_n").alias("n_test"), F.count("*").alias("test_subjects"), F.count_if(F.col("_folds") > 1).alias("_shared"))
    classes = df.groupBy(fold).agg(F.countDistinct(label).alias("test_classes"))
    whole = F.broadcast(per.agg(F.sum("_n").alias("_rows"), F.countDistinct(subject).alias("_subjects")))  # one row
    out = per_fold.join(classes, fold).join(whole, F.lit(True))
    only_here = F.col("test_subjects") - F.col("_shared")
    return out.select(fold, (F.col("_rows") - F.col("n_test")).alias("n_train"), "n_test", (F.col("_subjects") - only_here).alias("train_subjects"), "test_subjects", "test_classes", (F.col("_shared") > 0).alias("leak"))


def effect_over_noise(segments: DataFrame, pairs: DataFrame, value: str, keys: tuple[str, ...], before: str = "before", after: str = "after") -> DataFrame:
    """Segments (keys, value) and pairs (before, after) -> one row: within_sd, between_sd, effect_median, up_after, effect_over_noise.

    within_sd is the median over groups of the sd within them, between_sd the sd of the values before, up_after the share of
    pairs that rise, and the last one the median size of the change in within_sd's. Incomplete pairs are left out.
    """
    sds = segments.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"))
    within = sds.agg(F.percentile("_sd", F.lit(0.5)).alias("within_sd"))
    d = F.col(after) - F.col(before)
    change = pairs.agg(
        F.stddev_samp(before).alias("between_sd"), F.percentile(d, F.lit(0.5)).alias("effect_median"), F.avg(F.when(d.isNotNull(), (d > 0).cast("int"))).alias("up_after"), F.percentile(F.abs(d), F.lit(0.5)).alias("_size")
    )
    return change.join(F.broadcast(within), F.lit(True)).select("within_sd", "between_sd", "effect_median", "up_after", (F.col("_size") / F.nullif(F.col("within_sd"), F.lit(0.0))).alias("effect_over_noise"))


def median_by_state(df: DataFrame, value: str, state: str, states: list[str], subject: str = "subject_id") -> DataFrame:
    """-> (subject, one column a state): medians of the subjects that have a value in every one of the states."""
    known = df.where(F.col(state).isin(states) & F.col(value).isNotNull())
    wide = known.groupBy(subject).pivot(state, states).agg(F.percentile(value, F.lit(0.5)))
    return wide.dropna(subset=states)
