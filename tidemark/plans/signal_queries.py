"""Signal kernels over generated scans and windows: planted rates by embedding label, so that results can be checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scans as judging
from tidemark.operators import signals
from tidemark.plans.registry import query, rounded


def scans(read, seconds: int = 20, fs: int = 30):
    """One scan for each embedding: colours with a pulse of 60 + 3 * label beats a minute and the vector as noise."""
    i = F.sequence(F.lit(0), F.lit(seconds * fs - 1))
    rate = (F.col("label") * 3 + 60) / 60.0
    t = F.transform(i, lambda k: k / float(fs))
    noise = lambda k: F.coalesce(F.get("embedding", k % 64), F.lit(0.0)) * 0.1

    def colour(k):
        p = F.sin(k / float(fs) * rate * 6.283185307179586)
        return F.array(120.0 + 0.3 * p + noise(k), 90.0 + 0.8 * p + noise(k + 7), 80.0 + 0.5 * p + noise(k + 13))

    return read("embeddings").select("vec_id", "label", t.alias("t"), F.transform(i, colour).alias("rgb"))


def pulses(read, seconds: int = 60, fs: int = 16):
    i = F.sequence(F.lit(0), F.lit(seconds * fs - 1))
    rate = (F.col("label") * 3 + 60) / 60.0
    wave = lambda k: F.sin(k / float(fs) * rate * 6.283185307179586) + 0.2 * F.coalesce(F.get("embedding", k % 64), F.lit(0.0))
    return read("embeddings").select("vec_id", "label", F.transform(i, wave).alias("pulse"))


@query()
def pos_hr(spark, read):
    return rounded(signals.scan_features(scans(read), ["vec_id", "label"], "t", "rgb", how="v1"), "hr", "snr", "rr", digits=3)


@query()
def scan_hr(spark, read):
    return rounded(signals.scan_features(scans(read), ["vec_id", "label"], "t", "rgb"), "hr", "snr", "rr", digits=3)


@query()
def welch_bands(spark, read):
    out = signals.interval_features(pulses(read), ["vec_id", "label"], "pulse", 16.0)
    return rounded(out, "hr", "rmssd", "sdnn", "LF_power", "HF_power", "total_power", digits=4)


@query()
def skin_responses(spark, read):
    """The vector as a slow signal: each value held for two seconds at 4 Hz."""
    i = F.sequence(F.lit(0), F.lit(511))
    df = read("embeddings").select("vec_id", F.transform(i, lambda k: 2.0 + F.coalesce(F.get("embedding", F.floor(k / 8).cast("int")), F.lit(0.0))).alias("eda"))
    return rounded(signals.skin_features(df, ["vec_id"], "eda", 4.0), "mean_tonic", "std_phasic", "mean_amplitude", "mean_rise", "mean_recovery", digits=4)


@query()
def bandpass_peaks(spark, read):
    """Band-passed pulse windows and their number of beats."""

    def kernel(x):
        y = signals.zero_phase(x, 16.0, 0.5, 4.0, 4)
        return {"power": float((y**2).mean()), "n": len(signals.pulse_peaks(y, 16.0))}

    return rounded(signals.per_row(pulses(read), ["vec_id", "label"], ["pulse"], kernel, "power double, n bigint"), "power", digits=4)


@query()
def nlms_cancel(spark, read):
    """Power left after the noise, given as reference, is cancelled from the pulse."""

    def kernel(pulse, noise):
        ref = noise[:, None]
        left = signals.cancel(pulse + 3 * noise, ref)
        return {"before": float(((3 * noise) ** 2).mean()), "after": float(((left - pulse) ** 2).mean())}

    df = pulses(read).withColumn("noise", F.transform("pulse", lambda p, k: F.sin(k * 0.9)))
    return rounded(signals.per_row(df, ["vec_id"], ["pulse", "noise"], kernel, "before double, after double"), "before", "after", digits=4)


def camera_samples(read, seconds: int = 12, fs: int = 30):
    """Frames of one camera scan for each embedding: three regions with the pulse of `scans`, a steady face and light."""
    t = F.transform(F.sequence(F.lit(0), F.lit(seconds * fs - 1)), lambda k: F.struct(k.alias("k"), (k / float(fs)).alias("t")))
    rate = (F.col("label") * 3 + 60) / 60.0
    frames = read("embeddings").withColumn("rate", rate).select("vec_id", "label", "rate", "embedding", F.inline(t))
    noise = lambda shift: F.coalesce(F.get("embedding", (F.col("k") + shift) % 64), F.lit(0.0)) * 0.05
    p = F.sin(F.col("t") * F.col("rate") * 6.283185307179586)
    region = lambda n: F.array(120.0 + 0.3 * p + noise(n), 90.0 + 0.8 * p + noise(n + 7), 80.0 + 0.5 * p + noise(n + 13))
    still = lambda size, turn: F.lit(size) + F.sin(F.col("t") * turn) * 0.05
    return frames.select(
        "vec_id", "label", "t", region(0).alias("forehead"), region(21).alias("left"), region(42).alias("right"), still(50.0, 3.1).alias("x"), still(40.0, 1.7).alias("y"), F.lit(100.0).alias("width"),
        (120.0 + F.sin(F.col("t") * 0.9)).alias("brightness"), F.lit(0.1).alias("blink"), F.lit(0.1).alias("mouth"),
    )


@query()
def scan_judgement(spark, read):
    """Every camera scan judged whole, with its movement cancelled, and by windows."""
    return rounded(judging.judge_scans(camera_samples(read), ["vec_id", "label"]), "bpm", "snr", "start", digits=3)


@query()
def fused_hr(spark, read):
    """Rate and agreement of the three regions' fused pulse."""
    arrays = camera_samples(read).groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct(*signals.SAMPLE))).alias("s"))
    arrays = arrays.select("vec_id", "label", *[F.col(f"s.{c}").alias(c) for c in signals.SAMPLE])
    return rounded(signals.scan_figures(arrays, ["vec_id", "label"]), "bpm", "snr", "motion_amp", "motion_frac", "light_ratio", "light_amp", digits=3)


@query()
def pulse_rhythm(spark, read):
    """Intervals of every pulse around its planted rate, with a hole of two seconds."""
    known = F.transform("pulse", lambda p, k: ((k < 320) | (k >= 352)).cast("double"))
    d = pulses(read).select("vec_id", "label", "pulse", (F.col("label") * 3 + 60).alias("rate"), known.alias("known"))
    out = signals.pulse_rhythm(d, ["vec_id", "label"], "pulse", "rate", 16.0, "known")
    return rounded(out, "mean_rr", "rmssd", "sdnn", "pnn50", "stress_index", digits=3)


@query()
def ecg_features(spark, read):
    """Chest signals with a narrow wave at each beat of the planted rate."""
    i = F.sequence(F.lit(0), F.lit(40 * 100 - 1))
    rate = (F.col("label") * 3 + 60) / 60.0
    wave = lambda k: F.exp(-F.pow((F.pmod(k / 100.0 * rate, F.lit(1.0)) - 0.5) / rate / 0.02, F.lit(2.0))) + 0.05 * F.coalesce(F.get("embedding", k % 64), F.lit(0.0))
    d = read("embeddings").select("vec_id", "label", F.transform(i, wave).alias("ecg"))
    return rounded(signals.ecg_features(d, ["vec_id", "label"], "ecg", 100.0), "hr", "rmssd", "sdnn", "LF_power", "HF_power", "total_power", digits=4)


@query()
def short_scans(spark, read):
    """What each scan would have shown had it been allowed to stop early."""
    return rounded(signals.short_scans(scans(read), ["vec_id", "label"], "t", "rgb"), "hr", "snr", digits=3)
