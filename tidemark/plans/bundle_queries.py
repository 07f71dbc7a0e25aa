"""Window bundles, breathing and vitals over recordings that Spark derives from `embeddings`, with planted rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import bundle, signals
from tidemark.operators.windows import sliding_windows
from tidemark.plans.registry import query, rounded
from tidemark.plans.signal_queries import scans

TURN = 6.283185307179586
#: Fixed value: labels whose waves (66 KB each) go to every task.
FEW = 200


def _value(k: Column) -> Column:
    return F.coalesce(F.get("embedding", (k % 64).cast("int")).cast("double"), F.lit(0.0))


def _signal(name: str, t0: float, fs: int, values: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(t0).alias("t0"), F.lit(float(fs)).alias("fs"), values.alias("values"))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _tiled(values: Column, period: int, n: int) -> Column:
    """These `period` values over and over, n in all."""
    times = -(-n // period)
    whole = F.flatten(F.array_repeat(values, times))
    return whole if times * period == n else F.slice(whole, 1, n)


def recordings(read, seconds: int = 130, only: tuple[str, ...] = ("BVP", "EDA", "HR", "ACC")):
    """Four signals a vector, of different starts and rates: a pulse of 60 + 3 * label beats a minute, skin, heart rate, movement.

    What repeats is computed once and laid end to end, a label's wave once for all its vectors; `values` holds all numbers of all samples.
    """
    d = read("embeddings")
    wave = lambda label: arrays.let((label * 3 + 60) / 60.0, lambda r: F.transform(_upto(64 * seconds), lambda k: F.sin(k / 64.0 * r * TURN)))
    labels = d.select(F.col("label").alias("_of")).distinct()
    if "BVP" not in only or labels.count() > FEW:
        d = d.withColumn("_wave", wave(F.col("label")))
    else:
        d = d.join(F.broadcast(labels.withColumn("_wave", wave(F.col("_of")))), F.col("label").eqNullSafe(F.col("_of")))
    noise = F.transform(_upto(64), lambda k: 0.1 * _value(k))
    pulse = arrays.let(_tiled(noise, 64, 64 * seconds), lambda x: F.zip_with("_wave", x, lambda a, b: a + b))
    skin = F.flatten(F.transform(_upto(64), lambda k: F.array_repeat(2.0 + 0.3 * _value(k), 8)))
    rate = F.transform(_upto(64), lambda k: F.col("label") * 3.0 + 60 + 5 * _value(k))
    moved = F.flatten(F.transform(_upto(64), lambda k: F.array(10 * _value(k), 64 + 10 * _value(k + 21), 10 * _value(k + 42))))
    signals_of = {
        "BVP": _signal("BVP", 1000.0, 64, pulse), "EDA": _signal("EDA", 1000.5, 4, _tiled(skin, 64 * 8, 4 * seconds)),
        "HR": _signal("HR", 1010.0, 1, _tiled(rate, 64, seconds - 10)), "ACC": _signal("ACC", 999.75, 32, _tiled(moved, 3 * 64, 3 * 32 * seconds)),
    }
    return d.select("vec_id", F.inline(F.array(*[signals_of[name] for name in only])))


def grid(read):
    segments = read("embeddings").select("vec_id", F.lit(1004.3).alias("start"), F.lit(1130.0).alias("end"))
    return sliding_windows(segments, 60.0, 30.0).select("vec_id", F.col("t0").alias("start"), F.col("t1").alias("end"))


@query()
def window_bundle(spark, read):
    """All features of each window of each recording."""
    return rounded(bundle.window_features(recordings(read), grid(read), ["vec_id"]), "start", "end", *bundle.FEATURES, digits=4)


def _stats(prefix: str, x: str) -> str:
    return f"round(list_avg({x}), 4) AS {prefix}_mean, round(list_aggregate({x}, 'stddev_samp'), 4) AS {prefix}_std"


def _ratios(prefix: str, x: str, fs: int) -> str:
    d = f"list_transform(range(1, len({x})), lambda i: ({x}[i + 1] - {x}[i]) * {fs})"
    return f"round(coalesce(list_avg(list_filter({d}, lambda v: v > 0)), 0), 4) AS {prefix}_ratio_up, round(coalesce(list_avg(list_filter({d}, lambda v: v < 0)), 0), 4) AS {prefix}_ratio_down"


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding AS e FROM embeddings),
w AS (SELECT vec_id, label, e, CAST(1004.3 + 30.0 * k AS DOUBLE) AS s, CAST(1064.3 + 30.0 * k AS DOUBLE) AS f FROM e, range(3) r(k)),
hr AS (SELECT *, [label * 3.0 + 60 + 5 * CAST(coalesce(e[CAST(i % 64 AS INT) + 1], 0) AS DOUBLE) FOR i IN range(CAST(greatest(0, ceil((s - 1010.0) * 1)) AS INT), CAST(least(120, floor((f - 1010.0) * 1)) AS INT))] AS h FROM w),
acc AS (SELECT *, [[10 * CAST(coalesce(e[CAST(i % 64 AS INT) + 1], 0) AS DOUBLE) / 64, (64 + 10 * CAST(coalesce(e[CAST((i + 21) % 64 AS INT) + 1], 0) AS DOUBLE)) / 64, 10 * CAST(coalesce(e[CAST((i + 42) % 64 AS INT) + 1], 0) AS DOUBLE) / 64]
  FOR i IN range(CAST(greatest(0, ceil((s - 999.75) * 32)) AS INT), CAST(least(4160, floor((f - 999.75) * 32)) AS INT))] AS a FROM hr),
m AS (SELECT *, [sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) FOR v IN a] AS g, [v[1] FOR v IN a] AS ax, [v[2] FOR v IN a] AS ay, [v[3] FOR v IN a] AS az FROM acc),
d AS (SELECT *, list_aggregate(g, 'median') AS c FROM m)
SELECT vec_id, round(s, 4) AS start, {_stats('hr', 'h')}, {_ratios('hr', 'h', 1)}, {_stats('x', 'ax')}, {_stats('y', 'ay')}, {_stats('z', 'az')}, {_stats('acc', 'g')}, {_ratios('acc', 'g', 32)},
  round(list_avg([abs(v - c) FOR v IN g]), 4) AS acc_dyn_mean FROM d"""
)
def bundle_arithmetic(spark, read):
    """The heart-rate and movement features of the same windows, which SQL can say."""
    return window_bundle_rows(read).select("vec_id", "start", *bundle.HEART_RATE, *bundle.MOVEMENT)


def window_bundle_rows(read):
    asked = (*bundle.HEART_RATE, *bundle.MOVEMENT)
    return rounded(bundle.window_features(recordings(read, only=("HR", "ACC")), grid(read), ["vec_id"], features=asked), "start", *asked, digits=4)


@query()
def scan_vitals(spark, read):
    """Everything that every face scan tells."""
    return rounded(signals.scan_vitals(scans(read), ["vec_id", "label"], "t", "rgb"), "hr", "snr", "hr_beats", "rmssd", "sdnn", "pnn50", "si", "rr", "ok_share", "stress", digits=3)


@query()
def scan_breathing(spark, read):
    """Head and light of a scan for each vector: both nod at 10 + label breaths a minute for even ids, at rates three apart for odd ones."""
    i = F.sequence(F.lit(0), F.lit(30 * 30 - 1))
    wave = lambda k, shift: F.sin(k / 30.0 * (F.col("label") + 10.0 + shift) / 60.0 * TURN)
    apart = F.when(F.col("vec_id") % 2 == 0, 0.0).otherwise(3.0)
    d = read("embeddings").select(
        "vec_id", "label", F.transform(i, lambda k: 0.4 + 0.004 * wave(k, 0.0) + 0.001 * _value(k)).alias("head"), F.transform(i, lambda k: 100 + 0.3 * wave(k, apart) + 0.05 * _value(k + 13)).alias("light")
    )
    return rounded(signals.scan_breathing(d, ["vec_id", "label"], "head", "light"), "breaths", "head_breaths", "light_breaths", digits=3)


@query()
def first_phase(spark, read):
    """All first-phase features of a minute of each vector's recording."""
    i = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rate = (F.col("label") * 3 + 60) / 60.0
    d = read("embeddings").select(
        "vec_id", "label", F.transform(i(60 * 64), lambda k: F.sin(k / 64.0 * rate * TURN) + 0.1 * _value(k)).alias("bvp"), F.transform(i(240), lambda k: 2.0 + 0.3 * _value(F.floor(k / 8))).alias("eda"),
        F.transform(i(240), lambda k: 33.0 + k / 400.0 + 0.01 * _value(k)).alias("temp"), *[F.transform(i(320), lambda k, s=s: _value(k + s)).alias(c) for c, s in (("x", 0), ("y", 21), ("z", 42))],
    )
    out = bundle.first_phase_features(d, ["vec_id", "label"], "bvp", "eda", "temp", {c: c for c in "xyz"})
    return rounded(out, *[f.name for f in out.schema if f.dataType.simpleString() == "double"], digits=4)
