"""Scan judgement, schedules, writers, splits and models on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, models, scans, service
from tidemark.sources import sinks

FRAME = "scan bigint, t double, brightness double, x double, y double, width double, blink double, mouth double"


def frames(spark, n=300, **over):
    rows = []
    for k in range(n):
        r = {"t": k / 30, "brightness": 120.0, "x": 50.0, "y": 50.0, "width": 100.0, "blink": 0.1, "mouth": 0.1} | {c: f(k) for c, f in over.items()}
        rows.append((1, *[float(r[c]) for c in ("t", "brightness", "x", "y", "width", "blink", "mouth")]))
    return spark.createDataFrame(rows, FRAME)


@pytest.mark.parametrize(
    ("over", "reason"),
    [
        ({}, None), ({"brightness": lambda k: 20 if k % 5 == 0 else 120}, "brightness"), ({"x": lambda k: 50 + (k % 2) * 9}, "motion"), ({"blink": lambda k: float(k % 2)}, "blink"), ({"t": lambda k: k / 30 + (5 if k > 150 else 0)}, "coverage"),
    ],
)
def test_gates(spark, over, reason):
    snr = spark.createDataFrame([(1, 3.0, 3)], "scan bigint, snr double, agree int")
    r = scans.quality_gates(frames(spark, **over), ["scan"], snr).first()
    assert (r.reason, r.passed) == (reason, reason is None)


def test_gates_of_the_pulse(spark):
    f = frames(spark)
    reason = lambda snr, agree: scans.quality_gates(f, ["scan"], spark.createDataFrame([(1, snr, agree)], "scan bigint, snr double, agree int")).first().reason
    assert (reason(-5.0, 3), reason(3.0, 1), reason(None, 3)) == ("snr", "roi", "snr")
    assert scans.quality_gates(frames(spark, 100), ["scan"]).first().reason == "short"


def test_face_state(spark):
    shut = lambda k: 0.9 if 30 <= k < 36 or 60 <= k < 66 else (0.4 if 36 <= k < 40 else 0.1)
    yawn = lambda k: 0.8 if 100 <= k < 160 or 200 <= k < 210 else 0.1
    r = scans.face_state(frames(spark, blink=shut, mouth=yawn), ["scan"]).first()
    assert (r.blinks, r.yawns) == (2, 1) and r.closed_share == pytest.approx(12 / 299)
    cut = scans.face_state(frames(spark, t=lambda k: k / 30 + (k > 130), mouth=yawn), ["scan"]).first()
    assert cut.yawns == 0 and cut.seconds == pytest.approx(298 / 30)
    assert scans.head_movement(frames(spark), ["scan"]).first().move == 0


def test_best_window(spark):
    w = spark.createDataFrame([(1, 0, 70.0, 5.0, True), (1, 5, 71.0, 2.0, True), (1, 10, 95.0, 9.0, False), (2, 0, 60.0, 5.0, True), (2, 5, 90.0, 1.0, True)], "scan bigint, start int, bpm double, snr double, passed boolean")
    assert [(r.scan, r.start) for r in scans.best_window(w, ["scan"]).collect()] == [(1, 0)]


def test_shares_and_modes(spark):
    got = spark.range(1).select(service.share_gauge(F.lit(10.0), [(F.lit(6.0), F.lit(4.0)), (F.lit(None).cast("double"), F.lit(7.0)), (F.lit(3.0), F.lit(None).cast("double"))]).alias("s")).first().s
    assert got == [6.0, 4.0, 0.0]
    z = spark.createDataFrame([(1.75, 2.5), (None, 2.5), (2.5, None), (None, None)], "n double, f double")
    a, b = service.fuse(F.col("n"), F.col("f"))
    assert [tuple(r) for r in z.select(a, b).collect()] == [(2.0, "border"), (2.0, "face"), (2.5, "night"), (None, "none")]


def test_writers(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        sinks.write_predictions(spark.range(1), str(tmp_path / "p"))
    a = spark.createDataFrame([("m", 1, 0.5)], "metric string, seq int, value double")
    one = sinks.upsert(spark, None, a, str(tmp_path / "v0"), ["metric"], "seq")
    two = sinks.upsert(spark, str(tmp_path / "v0"), a.selectExpr("metric", "2 as seq", "0.7D as value"), str(tmp_path / "v1"), ["metric"], "seq")
    assert one.count() == 1 and [r.value for r in two.collect()] == [0.7]
    assert sinks.markdown(a) == "| metric | seq | value |\n| - | - | - |\n| m | 1 | 0.5 |"


def test_splits_and_model(spark):
    rows = [(s, float(s % 2) + k / 100, None if k == 0 else float(k % 3), "B" if s % 2 else "A") for s in range(24) for k in range(6)]
    d = models.with_folds(spark.createDataFrame(rows, "subject_id bigint, a double, b double, label string"), folds=3)
    assert d.select("subject_id", "fold").distinct().count() == 24
    p = models.out_of_fold(d, "logistic", ["a", "b"])
    assert metrics.class_metrics(p, "label", "pred_label", ["A", "B"]).first().accuracy == 1.0 and p.count() == len(rows)
    share = models.subject_split(d, 0.3).groupBy("subject_id").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count()
    assert share == 0


@pytest.mark.parametrize(("figures", "reason"), [((0.006, 0.3, 0.1, 0.1), "interference"), ((0.006, 0.1, 0.1, 0.1), None), ((0.001, 0.9, 1.0, 0.0004), "interference"), ((0.001, 0.9, 1.0, 0.0002), None), ((None, None, None, None), None)])
def test_interference_gate(spark, figures, reason):
    table = spark.createDataFrame([(1, 3.0, 3, *figures)], "scan bigint, snr double, agree int, motion_amp double, motion_frac double, light_ratio double, light_amp double")
    assert scans.quality_gates(frames(spark), ["scan"], table).first().reason == reason
    weak = table.withColumn("snr", F.lit(-9.0))
    assert scans.quality_gates(frames(spark), ["scan"], weak).first().reason == (reason or "snr")


def test_windows_of_a_scan(spark):
    spans = spark.createDataFrame([(1, 0.0, 29.97), (2, 0.0, 19.97), (3, 100.0, 120.0), (4, 0.0, 20.4)], "scan bigint, t0 double, t1 double")
    got = {}
    for r in scans.lay_windows(spans).collect():
        got.setdefault(r.scan, []).append(round(r.start, 2))
    assert got == {1: [0.0, 5.0, 10.0, 14.97], 3: [0.0, 5.0], 4: [0.0, 5.0]}


def camera(spark, scan, bpm, seconds=30, still=lambda t: True, noise=0.0):
    import numpy as np

    rng, rows = np.random.default_rng(scan), []
    for k in range(seconds * 30):
        t = k / 30
        p = np.sin(2 * np.pi * bpm / 60 * t)
        shake = 0.0 if still(t) else 9.0 * (k % 2)
        region = [[float(v) for v in (120 + 0.3 * p + e[0], 90 + 0.8 * p + e[1], 80 + 0.5 * p + e[2])] for e in rng.normal(0, noise + (0 if still(t) else 2.0), (3, 3))]
        rows.append((scan, t, *region, 50.0 + shake, 50.0, 100.0, 120.0 if still(t) else 20.0, 0.1, 0.1))
    return spark.createDataFrame(rows, "scan bigint, t double, forehead array<double>, left array<double>, right array<double>, x double, y double, width double, brightness double, blink double, mouth double")


def test_scans_are_judged_whole_or_by_windows(spark):
    d = camera(spark, 1, 72.0, noise=0.05).unionByName(camera(spark, 2, 84.0, still=lambda t: t < 22, noise=0.05)).unionByName(camera(spark, 3, 66.0, still=lambda t: False))
    got = {r.scan: r for r in scans.judge_scans(d, ["scan"]).collect()}
    assert (got[1].method, got[1].passed, got[1].start, got[1].agree) == ("fused", True, None, 3) and got[1].bpm == pytest.approx(72, abs=1.5)
    assert got[2].passed and got[2].method.endswith("+window") and got[2].start in (0.0, 5.0) and got[2].bpm == pytest.approx(84, abs=1.5)
    assert (got[3].passed, got[3].reason) == (False, "brightness")


def test_rows_reach_kernels_as_views_of_a_batch():
    """Rows of a batch, sliced or null, come out as they are, and a thousand scans take little more than their numbers."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import pytest

    from tidemark.operators import signals

    nested = pa.array([[[9.0, 9.0]], [[1.0, 2.0], [3.0, None]], None, [], [[5.0, 6.0]]], pa.list_(pa.list_(pa.float64()))).slice(1)
    a, b, c, d = signals._row_arrays(nested)
    assert np.array_equal(a, [[1, 2], [3, np.nan]], equal_nan=True) and b is None and len(c) == 0 and d.tolist() == [[5, 6]]
    assert [x.tolist() for x in signals._row_arrays(pa.array([[0], [1, 2]], pa.list_(pa.int32())).slice(1))] == [[1.0, 2.0]]
    with pytest.raises(ValueError, match="differ in length"):
        list(signals._row_arrays(pa.array([[[1.0], [1.0, 2.0]]])))
    numbers = pa.ListArray.from_arrays(np.arange(0, 1_800_001, 3, dtype=np.int32), pa.array(np.arange(1_800_000.0)))
    scans = pa.ListArray.from_arrays(np.arange(0, 600_001, 600, dtype=np.int32), numbers)
    tracemalloc.start()
    total = sum(float(x.sum()) for x in signals._row_arrays(scans))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 1_800_000 * 1_799_999 / 2 and peak < 10e6
