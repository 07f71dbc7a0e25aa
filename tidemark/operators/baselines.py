"""Personal baselines: rolling references over calendar frames, group references, scores against them.

Every frame is per subject, so one shuffle on the subject serves all of an operator's windows. Frame lists are
bounded by the frame (28 days), never by the subject's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays, ranges

MAD_SCALE = 1.4826


def past(days: int, lag: int = 0, subject: str = "subject_id", day: str = "day") -> Window:
    """Frame [d - lag - days, d - lag) of calendar days before each row; never the row's own day."""
    return Window.partitionBy(subject).orderBy(F.unix_date(F.col(day))).rangeBetween(-(lag + days), -(lag + 1))


def rolling_reference(df: DataFrame, col: str, days: int = 28, lag: int = 7, valid: str | None = "valid", subject: str = "subject_id", day: str = "day") -> DataFrame:
    """`df` with ref_n, ref_median and ref_mad (not scaled) of the valid values in the past frame."""
    usable = F.when(F.col(valid), F.col(col)) if valid else F.col(col)
    out = df.withColumn("_ref", F.collect_list(usable).over(past(days, lag, subject, day)))
    out = out.withColumn("ref_n", F.size("_ref").cast("bigint")).withColumn("ref_median", arrays.median(F.col("_ref")))
    return out.withColumn("ref_mad", arrays.mad(F.col("_ref"), F.col("ref_median"))).drop("_ref")


def rolling_z(df: DataFrame, col: str = "x", days: int = 28, lag: int = 7, min_n: int = 14, valid: str = "valid", out: str = "z", mad_floor: float | None = None) -> DataFrame:
    """`df` with the robust z of `col` against the subject's own past.

    NULL if the row is not valid, the reference has fewer than min_n values, or its MAD is 0 - then a floor may stand in.
    """
    ref = rolling_reference(df, col, days, lag, valid)
    scale = F.col("ref_mad") * MAD_SCALE
    scale = F.when(scale > 0, scale).otherwise(F.lit(mad_floor)) if mad_floor else F.nullif(scale, F.lit(0.0))
    z = (F.col(col) - F.col("ref_median")) / scale
    return ref.withColumn(out, F.when(F.col(valid) & (F.col("ref_n") >= min_n), z)).drop("ref_n", "ref_median", "ref_mad")


def rolling_quantile(df: DataFrame, col: str, q: float, days: int = 28, lag: int = 0, min_n: int = 14, out: str = "q") -> DataFrame:
    """`df` with the subject's own past quantile of `col`; NULL below min_n values."""
    w = past(days, lag)
    values = F.collect_list(F.col(col).cast("double")).over(w)
    return df.withColumn("_ref", values).withColumn(out, F.when(F.size("_ref") >= min_n, arrays.quantile(F.col("_ref"), q))).drop("_ref")


def mode_ladder(df: DataFrame, valid: str = "valid", subject: str = "subject_id") -> DataFrame:
    """`df` with n_valid of the subject and baseline_mode: early below 2 valid days, adapting below 21, else personal."""
    n = F.count_if(F.col(valid)).over(Window.partitionBy(subject))
    mode = F.when(F.col("n_valid") < 2, "early").when(F.col("n_valid") < 21, "adapting").otherwise("personal")
    return df.withColumn("n_valid", n).withColumn("baseline_mode", mode)


def reference_rows(df: DataFrame, mode: str = "low_activity", activity: str = "activity", label: str = "label", time: str = "t", share: float = 0.5, min_n: int = 3, keys: tuple[str, ...] = ("subject_id",), out: str = "is_ref") -> DataFrame:
    """`df` with a flag for the rows that form each group's reference; all its rows where the mode picks fewer than min_n.

    low_activity: at most the group's quantile `share` of activity; labeled_rest: label REST; temporal: the first
    max(min_n, floor(n * share)) rows by time; all.
    """
    w = Window.partitionBy(*keys)
    if mode == "all":
        return df.withColumn(out, F.lit(True))
    if mode == "labeled_rest":
        picked = F.coalesce(F.col(label) == "REST", F.lit(False))
    elif mode == "low_activity":
        picked = F.coalesce(F.col(activity) <= F.percentile(F.col(activity), F.lit(share)).over(w), F.lit(False))
    elif mode == "temporal":
        k = F.greatest(F.lit(min_n), F.floor(F.count("*").over(w) * F.lit(share)))
        picked = F.row_number().over(w.orderBy(time)) <= k
    else:
        raise ValueError(mode)
    marked = df.withColumn("_picked", picked)
    return marked.withColumn(out, F.col("_picked") | (F.count_if(F.col("_picked")).over(w) < min_n)).drop("_picked")


def global_z(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """(x - mean) / population sd over all rows; sd 1 where it is 0. One small aggregate joined back by broadcast."""
    stats = df.agg(F.avg(col).alias("_mean"), F.stddev_pop(col).alias("_sd"))
    sd = F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
    one = F.broadcast(stats)  # one row
    return df.join(one, F.lit(True)).withColumn(out, (F.col(col) - F.col("_mean")) / sd).drop("_mean", "_sd")


def global_percentile(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """(share of all values strictly less - 0.5) * 4.

    The share comes from counts of distinct values: a running count over value ranges, whose totals are few.
    """
    return _share_below(df, col, [], out)


def subject_percentile(df: DataFrame, col: str, ref: str = "is_ref", subject: str = "subject_id", out: str = "score") -> DataFrame:
    """(share of the subject's reference values strictly less - 0.5) * 4; all its rows where it has fewer than 3."""
    w = Window.partitionBy(subject)
    marked = df.withColumn("_in", F.col(ref) | (F.count_if(F.col(ref)).over(w) < 3))
    usable = F.col("_in") & F.col(col).isNotNull()
    below = F.count_if(usable).over(w.orderBy(col).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count_if(usable).over(w.orderBy(col).rangeBetween(0, 0))
    n = F.nullif(F.count_if(usable).over(w), F.lit(0))
    return marked.withColumn(out, F.when(F.col(col).isNotNull(), (below / n - 0.5) * 4.0)).drop("_in")


def _share_below(df: DataFrame, col: str, keys: list[str], out: str) -> DataFrame:
    """Counts of distinct values, ranked within ranges between quantiles: no task orders more than some of the ranges."""
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    cuts = ranges.bounds(df, col)
    per_value = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")).withColumn("_bin", ranges.range_of(F.col(col), cuts))
    per_bin = per_value.groupBy("_bin").agg(F.sum("_n").alias("_in_bin"))  # at most one row a range
    before = per_bin.withColumn("_before", F.sum("_in_bin").over(Window.orderBy("_bin")) - F.col("_in_bin")).select("_bin", "_before")
    running = F.sum("_n").over(Window.partitionBy("_bin").orderBy(col)) - F.col("_n")
    shares = per_value.withColumn("_less", running).join(F.broadcast(before), "_bin").select(F.col(col).alias("_v"), ((F.col("_less") + F.col("_before")) / n).alias("_share"))
    return df.join(ranges.narrow(shares), F.col(col) == F.col("_v"), "left").withColumn(out, (F.col("_share") - 0.5) * 4.0).drop("_v", "_share")


def subject_z(df: DataFrame, col: str, ref: str = "is_ref", subject: str = "subject_id", out: str = "score") -> DataFrame:
    """(x - mean) / population sd of the subject's reference rows; of all its rows where it has fewer than 3; sd 1 for 0."""
    w = Window.partitionBy(subject)
    few = F.count_if(F.col(ref)).over(w) < 3
    x = F.when(F.col(ref) | F.col("_few"), F.col(col))
    sd = F.coalesce(F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("_few", few).withColumn("_sd", sd).withColumn("_mean", F.avg(x).over(w)).withColumn(out, (F.col(col) - F.col("_mean")) / F.col("_sd")).drop("_few", "_sd", "_mean")


def robust_z(df: DataFrame, cols: list[str], ref: str = "is_ref", keys: tuple[str, ...] = ("subject_id", "session")) -> DataFrame:
    """`df` with z_<col>: (x - median) / scaled MAD of the group's reference.

    NULL below 3 reference values; a MAD of 0 gives way to the population sd, that to 1.
    """
    w = Window.partitionBy(*keys)
    out = df
    for c in cols:
        x = F.when(F.col(ref), F.col(c))
        out = out.withColumn("_med", F.percentile(x, F.lit(0.5)).over(w)).withColumn("_n", F.count(x).over(w)).withColumn("_sd", F.stddev_pop(x).over(w))
        mad = F.percentile(F.when(F.col(ref), F.abs(F.col(c) - F.col("_med"))), F.lit(0.5)).over(w) * MAD_SCALE
        out = out.withColumn("_mad", mad)
        scale = F.coalesce(F.when(F.col("_mad") > 0, F.col("_mad")), F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(f"z_{c}", F.when(F.col("_n") >= 3, (F.col(c) - F.col("_med")) / scale)).drop("_med", "_n", "_sd", "_mad")
    return out


def deviation(df: DataFrame, signs: dict[str, int], how: str = "signed", weights: dict[str, float] | None = None, out: str = "deviation") -> DataFrame:
    """`df` with one score of its z_<col> columns.

    signed: only the part in the sign's direction counts; otherwise sizes do. Mean over the columns present, or
    `max`; with weights the weighted mean, NULL if any column is.
    """
    zs = {c: F.col(f"z_{c}") for c in signs}
    parts = [F.when(z.isNotNull(), F.greatest(z * signs[c], F.lit(0.0))) if how == "signed" else F.abs(z) for c, z in zs.items()]
    if weights:
        w = [float(weights.get(c, 1.0)) for c in signs]
        s = sum((p * k for p, k in zip(parts, w, strict=True)), F.lit(0.0)) / max(sum(w), 1e-9)
    else:
        there = F.filter(F.array(*parts), lambda v: v.isNotNull())
        s = F.when(F.size(there) > 0, F.array_max(there) if how == "max" else arrays.mean(there))
    return df.withColumn(out, s)


def last_rows(n: int, order: list[str], subject: str = "subject_id") -> Window:
    """The n rows before each row."""
    return Window.partitionBy(subject).orderBy(*order).rowsBetween(-n, -1)


def device_baseline(df: DataFrame, col: str, passed: Column, order: list[str], n: int = 30, min_n: int = 5, least_cut: float = 5.0, subject: str = "subject_id") -> DataFrame:
    """Passing rows with base, spread and level against the last n passing rows: high, low or same beyond max(5, 2 * spread)."""
    some = df.where(passed)
    ref = F.collect_list(F.col(col)).over(last_rows(n, order, subject))
    some = some.withColumn("_ref", ref).withColumn("base", F.when(F.size("_ref") >= min_n, arrays.median(F.col("_ref"))))
    some = some.withColumn("spread", F.when(F.size("_ref") >= min_n, arrays.mad(F.col("_ref"), F.col("base")))).drop("_ref")
    delta, cut = F.col(col) - F.col("base"), F.greatest(F.lit(least_cut), 2 * F.col("spread"))
    return some.withColumn("level", F.when(F.col("base").isNull(), "unknown").when(delta >= cut, "high").when(delta <= -cut, "low").otherwise("same"))


def previous_day_flag(df: DataFrame, flag: Column, subject: str = "subject_id", day: str = "day") -> Column:
    """Whether the row before is exactly yesterday's and has the flag."""
    w = Window.partitionBy(subject).orderBy(day)
    before = F.lag(F.struct(F.col(day).alias("d"), flag.alias("f"))).over(w)
    return F.coalesce((F.datediff(F.col(day), before["d"]) == 1) & before["f"], F.lit(False))
