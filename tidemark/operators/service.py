"""What a check-in service asks of its history: states, advice, baselines of the last days, boards, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays


def state_by_ratio(x: Column, base: Column, ratio: float, low: float | None = None) -> Column:
    """HIGH from base * ratio on, LOW up to base / ratio (or `low`), else NORMAL; NULL without a base."""
    return F.when(base.isNull() | x.isNull(), None).when(x >= base * ratio, "HIGH").when(x <= (base * low if low else base / ratio), "LOW").otherwise("NORMAL")


def study_mode(hour: Column, score: Column, stress: Column, sleep: Column) -> Column:
    """wrap late at night; light when low, tense or short of sleep; deep when high and calm; else split."""
    late = (hour >= 23) | (hour < 4)
    light = F.coalesce(score < 55, F.lit(False)) | F.coalesce(stress >= 70, F.lit(False)) | F.coalesce(sleep < 5, F.lit(False))
    deep = F.coalesce(score >= 75, F.lit(False)) & (stress.isNull() | (stress < 50))
    return F.when(late, "wrap").when(light, "light").when(deep, "deep").otherwise("split")


def first_tips(tips: list[tuple[Column, str]], most: int = 3) -> Column:
    """The first so many texts whose conditions hold, in order."""
    return F.slice(F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in tips]), lambda x: x.isNotNull()), 1, most)


def phase_of(day: Column, exam_start: Column, exam_end: Column) -> Column:
    """prep in the week before, exam, recovery in the week after, else normal."""
    return F.when(day.between(exam_start, exam_end), "exam").when(day.between(F.date_sub(exam_start, 7), F.date_sub(exam_start, 1)), "prep").when(day.between(F.date_add(exam_end, 1), F.date_add(exam_end, 7)), "recovery").otherwise("normal")


def recent_baseline(df: DataFrame, value: str, days: int = 14, min_n: int = 3, subject: str = "subject_id", ts: str = "ts", usable: Column | None = None, out: str = "base") -> DataFrame:
    """`df` with the median of the subject's usable values in the days strictly before each row; NULL below min_n.

    The frame is in microseconds, so that rows of the same instant do not count for each other.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(subject).orderBy(at).rangeBetween(-days * 86_400_000_000, -1)
    values = F.collect_list(F.when(usable, F.col(value)) if usable is not None else F.col(value)).over(w)
    return df.withColumn("_ref", values).withColumn(out, F.when(F.size("_ref") >= min_n, arrays.median(F.col("_ref")))).drop("_ref")


def routine_baseline(df: DataFrame, value: str, prep: Column, days: int = 7, min_n: int = 4, mad_floor: float = 1.0, keys: tuple[str, ...] = ("subject_id", "routine"), day: str = "day") -> DataFrame:
    """`df` with base, spread and ready: of the earlier prep rows if there are min_n, else of the days before."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day))
    earlier = F.collect_list(F.when(prep, F.col(value))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    recent = F.collect_list(F.col(value)).over(w.rangeBetween(-days, -1))
    out = df.withColumn("_prep", earlier).withColumn("_recent", recent)
    out = out.withColumn("_ref", F.when(F.size("_prep") >= min_n, F.col("_prep")).otherwise(F.col("_recent")))
    out = out.withColumn("base", arrays.median(F.col("_ref"))).withColumn("ready", F.size("_ref") >= min_n)
    return out.withColumn("spread", F.greatest(arrays.mad(F.col("_ref"), F.col("base")) * 1.4826, F.lit(mad_floor))).drop("_prep", "_recent", "_ref")


def judge(value: Column, base: Column, spread: Column, ready: Column, usable: Column, k: float = 2.5) -> Column:
    return F.when(~usable, "low").when(~ready, "building").when(F.abs(value - base) >= k * spread, "diff").otherwise("same")


def week_grid(days: DataFrame, today: Column, value: str, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """(subject, day, n, median) for the seven days up to today of every subject, days without rows included."""
    grid = days.select(subject).distinct().select(subject, F.explode(F.sequence(F.date_sub(today, 6), today)).alias(day))
    per_day = days.groupBy(subject, day).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))
    return grid.join(per_day, [subject, day], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def fuse(night_z: Column, face_z: Column, limit: float = 2.0, border: float = 1.5, face_cut: float = 2.5) -> tuple[Column, Column]:
    """(z, source): a borderline night is lifted by a high face z; a face alone is scaled to the night's limit."""
    lifted = (night_z >= border) & (night_z < limit) & (face_z >= limit)
    z = F.when(night_z.isNull(), face_z * limit / face_cut).when(lifted, limit).otherwise(night_z)
    source = F.when(night_z.isNull() & face_z.isNull(), "none").when(night_z.isNull(), "face").when(F.coalesce(lifted, F.lit(False)), "border").otherwise("night")
    return z, source


def intraday_rise(samples: DataFrame, value: str, order: str, keys: tuple[str, ...] = ("subject_id", "day"), recent: int = 4, least: int = 8, rise: float = 6.0) -> DataFrame:
    """-> keys, n, rise, rising: the mean of the last few values less the median of the lower half of those before.

    Rising if three quarters of the last ones are at least `rise` above. Days below `least` values are left out.
    """
    folded = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_s")).where(F.size("_s") >= least)
    folded = folded.withColumn("_v", F.transform("_s", lambda s: s["v"]))
    n = F.size("_v")
    last = F.slice("_v", n - recent + 1, F.lit(recent))
    before = F.array_sort(F.slice("_v", F.lit(1), n - recent))
    half = F.slice(before, F.lit(1), F.greatest(F.floor(F.size(before) / 2).cast("int"), F.lit(1)))
    out = folded.withColumn("_last", last).withColumn("_stable", arrays.median(half))
    out = out.withColumn("n", n.cast("bigint")).withColumn("rise", arrays.mean(F.col("_last")) - F.col("_stable"))
    share = F.size(F.filter("_last", lambda v: v - F.col("_stable") >= rise)) / F.size("_last")
    return out.withColumn("rising", share >= 0.75).select(*keys, "n", "rise", "rising")


def share_gauge(total: Column, causes: list[tuple[Column, Column]]) -> Column:
    """For causes in order, how much of the total each explains: the larger of sensed and confirmed, capped by what is left."""
    wanted = F.array(*[F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))) for a, b in causes])
    start = F.struct(total.alias("left"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(x, F.greatest(acc["left"], F.lit(0.0)))
        return F.struct((acc["left"] - take).alias("left"), F.concat(acc["out"], F.array(take)).alias("out"))

    return F.aggregate(wanted, start, step, lambda acc: acc["out"])


def final_state(days: DataFrame, min_night: int = 60) -> DataFrame:
    """Days (valid, deviated, pending, held, alert, night_hr, night_min, face_valid) -> the same with `state`.

    Without a verdict: learning if there is a night of enough minutes or a face scan, else none. Deviating days ask, are
    explained, alert or are left open, in this order; all others are calm.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    night = F.col("night_hr").isNotNull() & F.coalesce(F.col("night_min") >= min_night, F.lit(False))
    unknown = F.when(night | yes("face_valid"), "learning").otherwise("none")
    state = F.when(~yes("valid"), unknown).when(~yes("deviated"), "calm").when(yes("pending"), "ask").when(yes("held"), "explained").when(yes("alert"), "alert").otherwise("left")
    return days.withColumn("state", state)


def shown_run(days: DataFrame, keys: tuple[str, ...] = ("subject_id",), day: str = "day") -> DataFrame:
    """-> (keys, run): the run length of the latest judged day; a day without verdict or held shows the one before it."""
    judged = F.coalesce(F.col("valid"), F.lit(False)) & ~F.coalesce(F.col("held"), F.lit(False))
    return days.groupBy(*keys).agg(F.coalesce(F.max_by("run_len", F.when(judged, F.col(day))), F.lit(0)).cast("bigint").alias("run"))



def judge_complexion(change: Column, made_up: Column, base: Column, spread: Column, ready: Column, k: float = 2.5) -> Column:
    """Redness as a second sign: excluded under make-up, building without a baseline, else diff or same."""
    unknown = change.isNull() | ~F.coalesce(ready, F.lit(False))
    return F.when(F.coalesce(made_up, F.lit(False)), "excluded").when(unknown, "building").when(F.abs(change - base) >= k * spread, "diff").otherwise("same")


def unexplained_share(total: Column, shares: Column, streaking: Column, least: int = 60) -> tuple[Column, Column]:
    """(percent of the total that the shares leave, whether it alerts): a streak whose rest is at least `least` percent."""
    rest = F.greatest(F.lit(0), F.round((total - arrays.total(shares)) / F.nullif(total, F.lit(0.0)) * 100).cast("int"))
    return rest, streaking & (rest >= least)
