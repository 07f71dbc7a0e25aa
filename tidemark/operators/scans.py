"""Judging camera scans: quality gates, face state, the best window; and the day's schedule and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import signals
from tidemark.session import written


def quality_gates(samples: DataFrame, keys: list[str], snr: DataFrame | None = None, t: str = "t", least: int = 240, hole: float = 0.25) -> DataFrame:
    """Samples (keys, t, brightness, x, y, width, blink, mouth) and a table (keys, snr, agree and perhaps motion_amp,
    motion_frac, light_ratio, light_amp) -> one row a scan.

    Gates in the order in which they give the reason: brightness, motion, blink, coverage, interference (the face moves or
    the light flickers at the pulse's rate), snr, roi; `short` below `least` samples (or coverage, if that is what is
    missing). Unknown figures pass, but for the SNR. One shuffle on the keys serves window and fold.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    gap = F.col(t) - F.lag(t).over(w)
    moved = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    s = samples.withColumn("_gap", gap).withColumn("_still", F.coalesce(moved < 0.05 * F.col("width"), F.lit(True)))
    share = lambda c: F.avg(c.cast("int"))
    out = s.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.col("brightness").between(55, 225)).alias("bright_share"), share(F.col("_still")).alias("still_share"), share((F.col("blink") > 0.5) | (F.col("mouth") > 0.5)).alias("blink_share"),
        (F.sum(F.when(F.col("_gap") <= hole, F.col("_gap")).otherwise(0.0)) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("coverage"), F.max("_gap").alias("max_gap"),
    )
    out = out.join(snr.select(*keys, *[c for c in snr.columns if c in FIGURES]), keys, "left") if snr is not None else out
    return _with_reason(out, least)


#: What the gates take of a pulse.
FIGURES = {"snr": "double", "agree": "int", "motion_amp": "double", "motion_frac": "double", "light_ratio": "double", "light_amp": "double"}


def _with_reason(shares: DataFrame, least: int) -> DataFrame:
    """Rows with a scan's shares and perhaps FIGURES -> the same, `reason` and `passed`."""
    out = shares.withColumns({c: F.lit(None).cast(kind) for c, kind in FIGURES.items() if c not in shares.columns})
    moving = (F.col("motion_amp") >= 0.005) & (F.col("motion_frac") >= 0.2)
    flicker = (F.col("light_amp") >= 0.0003) & (F.col("light_ratio") >= 0.95)
    covered = F.coalesce((F.col("coverage") >= 0.85) & (F.col("max_gap") <= 1.5), F.lit(True))
    reason = (
        F.when(F.col("n") < least, F.when(covered, "short").otherwise("coverage"))
        .when(F.col("bright_share") < 0.9, "brightness")
        .when(F.col("still_share") < 0.85, "motion")
        .when(F.col("blink_share") >= 0.3, "blink")
        .when(~covered, "coverage")
        .when(F.coalesce(moving, F.lit(False)) | F.coalesce(flicker, F.lit(False)), "interference")
        .when(~F.coalesce(F.col("snr") >= -3, F.lit(False)), "snr")
        .when(F.coalesce(F.col("agree") < 2, F.lit(False)), "roi")
    )
    return out.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def gate_shares(hole: float = 0.25) -> dict[str, Column]:
    """The shares that quality_gates judges by, of one row's arrays in order of time: no shuffle."""
    share = lambda a: arrays.let(F.filter(a, lambda v: v.isNotNull()), lambda known: F.size(F.filter(known, lambda v: v)) / F.nullif(F.size(known), F.lit(0)))
    before = lambda c, i: F.get(F.col(c), i - 1)
    gaps = F.transform("t", lambda v, i: v - before("t", i))
    moved = F.transform("x", lambda v, i: F.hypot(v - before("x", i), F.get("y", i) - before("y", i)))
    seen = lambda all_gaps: F.aggregate(all_gaps, F.lit(0.0), lambda acc, g: acc + F.when(g <= hole, g).otherwise(0.0))
    return {
        "n": F.size("t").cast("bigint"), "bright_share": share(F.transform("brightness", lambda v: v.between(55, 225))), "still_share": share(F.zip_with(moved, "width", lambda m, w: F.coalesce(m < 0.05 * w, F.lit(True)))),
        "blink_share": share(F.zip_with("blink", "mouth", lambda b, m: (b > 0.5) | (m > 0.5))), "coverage": seen(gaps) / F.nullif(F.array_max("t") - F.array_min("t"), F.lit(0.0)), "max_gap": F.array_max(gaps),
    }


def face_state(samples: DataFrame, keys: list[str], t: str = "t", hole: float = 0.25) -> DataFrame:
    """-> keys, seconds, blinks, closed_share, yawns: blinks with hysteresis (0.5 on, 0.35 off), yawns of 1.5 s or more.

    A gap closes what is open: what happened in it is not known. The fold is sequential, over one scan's samples.
    """
    folded = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col("blink").cast("double").alias("b"), F.col("mouth").cast("double").alias("m")))).alias("_s"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("last"), F.lit(0.0).alias("seconds"), F.lit(0).alias("blinks"), F.lit(False).alias("shut"), F.lit(0.0).alias("closed"), F.lit(0).alias("yawns"), none.alias("since"), none.alias("till"))
    long = lambda acc: F.coalesce(acc["till"] - acc["since"] >= 1.5, F.lit(False)).cast("int")

    def step(acc: Column, s: Column) -> Column:
        dt = F.coalesce(s["t"] - acc["last"], F.lit(0.0))
        gap = dt > hole
        took = F.when(gap, 0.0).otherwise(dt)
        shut = acc["shut"] & ~gap
        yawning = s["m"] >= 0.6
        open_ = acc["since"].isNotNull() & ~gap
        ended = F.when(gap | ~yawning, long(acc)).otherwise(0)
        return F.struct(
            s["t"].alias("last"), (acc["seconds"] + took).alias("seconds"), (acc["blinks"] + (~shut & (s["b"] >= 0.5)).cast("int")).alias("blinks"),
            F.when(shut, s["b"] >= 0.35).otherwise(s["b"] >= 0.5).alias("shut"), (acc["closed"] + F.when(s["b"] >= 0.8, took).otherwise(0.0)).alias("closed"), (acc["yawns"] + ended).alias("yawns"),
            F.when(yawning, F.when(open_, acc["since"]).otherwise(s["t"])).alias("since"), F.when(yawning, s["t"]).alias("till"),
        )

    out = folded.where(F.size("_s") >= 2).withColumn("_f", F.aggregate("_s", start, step, lambda acc: F.struct(acc["seconds"].alias("seconds"), acc["blinks"].alias("blinks"), acc["closed"].alias("closed"), (acc["yawns"] + long(acc)).alias("yawns"))))
    return out.select(*keys, F.col("_f.seconds").alias("seconds"), F.col("_f.blinks").cast("bigint").alias("blinks"), (F.col("_f.closed") / F.nullif(F.col("_f.seconds"), F.lit(0.0))).alias("closed_share"), F.col("_f.yawns").cast("bigint").alias("yawns"))


def head_movement(samples: DataFrame, keys: list[str]) -> DataFrame:
    """-> keys, move: upper-middle distance (in face widths, %) from the upper-middle position."""
    upper = lambda a: F.element_at(F.array_sort(a), (F.size(a) / 2).cast("int") + 1)
    f = samples.groupBy(*keys).agg(F.collect_list(F.struct((F.col("x") / F.col("width")).alias("x"), (F.col("y") / F.col("width")).alias("y"))).alias("_p"))
    f = f.withColumn("_cx", upper(F.transform("_p", lambda p: p["x"]))).withColumn("_cy", upper(F.transform("_p", lambda p: p["y"])))
    return f.select(*keys, (upper(F.transform("_p", lambda p: F.hypot(p["x"] - F.col("_cx"), p["y"] - F.col("_cy")))) * 100).alias("move"))


def best_window(windows: DataFrame, keys: list[str], agree: float = 3.0, least: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Windows (keys, start, bpm, snr, passed) -> (keys, start, bpm, snr and `carry`): the clearest passing one that enough others support."""
    w = Window.partitionBy(*keys)
    some = windows.where("passed")
    top = F.max(F.struct("snr", (-F.col("start")).alias("s"), "bpm")).over(w)
    marked = some.withColumn("_top", top).withColumn("_near", F.count_if(F.abs(F.col("bpm") - F.col("_top.bpm")) <= agree).over(w))
    return marked.where((F.col("snr") == F.col("_top.snr")) & (F.col("start") == -F.col("_top.s")) & (F.col("_near") >= least)).select(*keys, "start", "bpm", "snr", *carry)


def lay_windows(spans: DataFrame, seconds: float = 15.0, step: float = 5.0) -> DataFrame:
    """Spans (keys, t0, t1) -> the same with `start`, seconds from t0, of each window: one every `step`, and one at the end
    if more than half a second would be left. Spans below one window and a step have none."""
    whole = F.col("t1") - F.col("t0")
    tail = whole - seconds
    n = F.floor((tail + 1e-6) / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n), lambda k: k * F.lit(float(step)))
    starts = F.when(tail - n * F.lit(float(step)) > 0.5, F.concat(starts, F.array(tail))).otherwise(starts)
    return spans.where(whole >= seconds + step).withColumn("start", F.explode(starts))


#: What a judged scan carries besides its rate: rhythm and breathing of the samples that were chosen.
CARRIED = [part.split()[0] for part in f"{signals.RHYTHM}, {signals.BREATHS}".split(", ")]


#: A scan's arrays.
ARRAYS = (*signals.SAMPLE, "blink", "mouth")

#: Fixed value: units (scans or windows) whose keys are sent to all tasks; more are joined by a shuffle.
FEW = 200_000


def _judged(units: DataFrame, keys: list[str], fs: float, cancelled: bool, least: int) -> DataFrame:
    """Units (keys and ARRAYS) -> (keys, bpm, snr, agree, reason, passed, CARRIED), written. Gates and pulse are of one row's arrays."""
    gated = units.withColumns(gate_shares()).drop("blink", "mouth")
    return written(_with_reason(signals.scan_figures(gated, keys, fs, cancelled), least).select(*keys, "bpm", "snr", "agree", "reason", "passed", *CARRIED))


def _failures(rows: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` of the units that did not pass. Where those are few, none of the rows crosses a shuffle for it."""
    failed = judged.where(~F.col("passed")).select(*keys)
    return rows.join(F.broadcast(failed) if failed.count() <= FEW else failed, keys, "left_semi")


def _retried(first: DataFrame, failed: DataFrame, keys: list[str], fs: float, least: int) -> DataFrame:
    """The judgements, those that failed replaced by one with the movement cancelled if that passes; `_way` is then 1."""
    second = _judged(failed, keys, fs, True, least).where("passed")
    kept = first.join(second.select(*keys), keys, "left_anti").withColumn("_way", F.lit(0))
    return kept.unionByName(second.withColumn("_way", F.lit(1)))


def judge_scans(samples: DataFrame, keys: list[str], fs: float = 30.0, seconds: float = 15.0, step: float = 5.0, least: int = 240) -> DataFrame:
    """Samples (keys and signals.SAMPLE, blink, mouth) -> one row a scan: keys, bpm, snr, agree, reason, passed, CARRIED,
    hrv_reliable, method, start.

    A cascade of which every stage sees the failures of the one before: scans whole; with the face's movement cancelled; their
    windows, whole and then with the movement cancelled. The clearest window that passes and that another one supports is
    taken, with its `start`; a scan without any keeps its first judgement. A scan's samples cross the shuffle once, to be
    gathered by its keys, and those of scans that failed once more, then written; windows are slices of a scan's arrays. Each
    stage's judgements are written, so that no stage is run twice. `hrv_reliable`: it passed, at an SNR of 10 dB or more and
    with 20 pairs of usable intervals.
    """
    spread = lambda rows, own: rows.select(*own, *[F.col(f"_s.{c}").alias(c) for c in ARRAYS])
    gathered = lambda rows: spread(rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ARRAYS))).alias("_s")), keys)
    first = _judged(gathered(samples), keys, fs, False, least)
    failed = written(gathered(_failures(samples, first, keys)))
    scans = written(_retried(first, failed, keys, fs, least))

    rest = _failures(failed, scans, keys)
    laid = lay_windows(rest.withColumns({"t0": F.array_min("t"), "t1": F.array_max("t")}), seconds, step)
    lo, own = F.col("t0") + F.col("start"), [*keys, "start"]
    parts = spread(laid.withColumn("_s", F.filter(F.arrays_zip(*ARRAYS), lambda s: s["t"].between(lo, lo + seconds))).where(F.size("_s") > 0), own)
    whole = _judged(parts, own, fs, False, least)
    windows = _retried(whole, _failures(parts, whole, own), own, fs, least)
    best = best_window(windows, keys, carry=("agree", "_way", *CARRIED)).withColumns({"passed": F.lit(True), "reason": F.lit(None).cast("string")})

    out = scans.join(best.select(*keys), keys, "left_anti").withColumn("start", F.lit(None).cast("double")).unionByName(best)
    method = F.concat(F.lit("fused"), F.when(F.col("_way") == 1, "+motion").otherwise(""), F.when(F.col("start").isNotNull(), "+window").otherwise(""))
    reliable = F.col("passed") & F.coalesce((F.col("snr") >= 10) & (F.col("pairs") >= 20), F.lit(False))
    return out.select(*keys, "bpm", "snr", "agree", "reason", "passed", *CARRIED, reliable.alias("hrv_reliable"), method.alias("method"), "start")


def routine_of(hour: Column, hint: Column | None = None) -> Column:
    """morning from 4, desk from 11, night from 20; a known hint wins."""
    by_hour = F.when(hour.between(4, 10), "morning").when(hour.between(11, 19), "desk").otherwise("night")
    return F.coalesce(F.when(hint.isin("morning", "desk", "night"), hint), by_hour) if hint is not None else by_hour


def due_now(schedule: DataFrame, minute: Column, done: Column, wait: int = 60, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Schedules (keys, routine, at: minute of the day, on) -> (keys, due, next): the latest open routine within `wait`
    minutes, and the next one, tomorrow's if need be."""
    on = schedule.where("on")
    late = minute - F.col("at")
    open_ = F.max(F.when(~done & late.between(0, wait - 1), F.struct("at", "routine")))
    ahead = F.when(F.col("at") > minute, F.col("at")).otherwise(F.col("at") + 1440)
    out = on.groupBy(*keys).agg(open_.alias("_due"), F.min(F.struct(ahead.alias("a"), "routine")).alias("_next"))
    return out.select(*keys, F.col("_due.routine").alias("due"), F.col("_next.routine").alias("next"))


def new_notices(states: DataFrame, notices: DataFrame, keys: tuple[str, ...] = ("subject_id", "day", "status")) -> DataFrame:
    """States that call for a notice and have none yet, once per key."""
    return states.where(F.col("status").isNotNull()).dropDuplicates(list(keys)).join(notices.select(*keys), list(keys), "left_anti")


def attach_reports(windows: DataFrame, reports: DataFrame, stages: dict[str, list[str]], base: str, keys: tuple[str, ...] = ("subject_id", "version")) -> DataFrame:
    """`windows` with self_report, self_report_delta and self_report_approx of their segment.

    reports has one row a key with a column for each stage; a segment that maps to several stages takes the mean of
    those given, marked approximate.
    """
    parts = []
    for segment, cols in stages.items():
        given = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
        parts.append(F.struct(F.lit(segment).alias("segment_name"), arrays.mean(given).alias("self_report"), F.lit(len(cols) > 1).alias("self_report_approx")))
    long = reports.select(*keys, F.col(base).cast("double").alias("_base"), F.inline(F.array(*parts)))
    long = long.withColumn("self_report_delta", F.col("self_report") - F.col("_base")).drop("_base")
    return windows.join(long, [*keys, "segment_name"], "left")


def missing_rates(df: DataFrame, cols: list[str], top: int = 10) -> DataFrame:
    """-> (feature, missing): the features most often missing."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in cols])
    return rates.select(F.inline(pairs)).orderBy(F.col("missing").desc(), "feature").limit(top)


def majority(votes: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """-> (keys, vote): the commonest vote, the least of equals."""
    n = votes.groupBy(*keys, vote).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(vote, F.struct((-F.col("_n")).alias("n"), vote)).alias(vote))


def value_shares(df: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """-> (keys, value, n, share) of each value."""
    n = df.groupBy(*keys, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    whole = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    joined = n.join(whole, list(keys)) if keys else n.join(F.broadcast(whole), F.lit(True))  # one row without keys
    return joined.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def with_pair(scans: DataFrame, id_col: str, pair: str, cols: list[str]) -> DataFrame:
    """`scans` with the columns of the scan that `pair` names, as before_*."""
    other = scans.select(F.col(id_col).alias("_pair"), *[F.col(c).alias(f"before_{c}") for c in cols])
    return scans.join(other, F.col(pair) == F.col("_pair"), "left").drop("_pair")
