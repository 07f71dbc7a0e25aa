"""The cascade of scan judgements: what is written, and gates of arrays against gates of samples; bundles of some features."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_bundle import SIGNALS, as_rows, recording
from tests.test_scans import camera
from tidemark.operators import bundle, scans
from tidemark.plans import bundle_queries


def test_gates_of_arrays_are_those_of_samples(spark):
    rng, rows = np.random.default_rng(2), []
    for scan in range(6):
        t = 100.0 * scan
        for k in range([1, 2, 30, 300, 300, 300][scan]):
            t += float(rng.choice([1 / 30, 0.2, 0.3, 2.0], p=[0.9, 0.05, 0.04, 0.01]))
            v = [float(rng.choice([120, 30])), *rng.normal(50, 2, 2).tolist(), 100.0, *rng.choice([0.1, 0.9], 2, p=[0.8, 0.2]).tolist()]
            rows.append((scan, t, *[None if rng.random() < 0.05 else a for a in v]))
    d = spark.createDataFrame(rows, "scan bigint, t double, brightness double, x double, y double, width double, blink double, mouth double")
    want = {r.scan: r.asDict() for r in scans.quality_gates(d, ["scan"]).collect()}
    cols = [c for c in d.columns if c != "scan"]
    held = d.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("s")).select("scan", *[F.col(f"s.{c}").alias(c) for c in cols])
    shares = list(scans.gate_shares())
    got = {r.scan: r.asDict() for r in held.withColumns(scans.gate_shares()).select("scan", *shares).collect()}
    assert len(got) == 6 and got == {k: {c: r[c] for c in ("scan", *shares)} for k, r in want.items()}


def test_samples_of_a_scan_that_passes_are_not_written(spark, monkeypatch):
    d = camera(spark, 1, 72.0, seconds=10, noise=0.05).unionByName(camera(spark, 3, 66.0, seconds=10, still=lambda t: False))
    tables, plain = [], scans.written
    monkeypatch.setattr(scans, "written", lambda df: tables.append(plain(df)) or tables[-1])
    got = {r.scan: r.passed for r in scans.judge_scans(d, ["scan"]).collect()}
    assert got == {1: True, 3: False}
    assert {r.scan for df in tables if "forehead" in df.columns for r in df.select("scan").collect()} == {3}


def test_more_failures_than_few_give_the_same_rows(spark, monkeypatch):
    d = camera(spark, 2, 84.0, still=lambda t: t < 22, noise=0.05).unionByName(camera(spark, 3, 66.0, seconds=10, still=lambda t: False))
    rows = lambda: sorted(map(tuple, scans.judge_scans(d, ["scan"]).collect()))
    few = rows()
    monkeypatch.setattr(scans, "FEW", 0)
    assert rows() == few and [r[5] for r in few] == [True, False]


# -- bundles -------------------------------------------------------------------------------------------------
def test_a_bundle_of_some_features_leaves_other_signals_behind(spark):
    """The asked features are those of the whole bundle; samples of other signals cross no shuffle, but make a recording."""
    full = recording(1, 70)
    rows = as_rows("a", full) + as_rows("skin", {"EDA": full["EDA"]})
    d = spark.createDataFrame(rows, SIGNALS)
    windows = spark.createDataFrame([(s, 1003.3, 1063.3) for s in ("a", "skin", "nobody")], "session string, start double, end double")
    asked = (*bundle.HEART_RATE, *bundle.MOVEMENT)
    some = bundle.window_features(d, windows, ["session"], features=asked)
    whole = bundle.window_features(d, windows, ["session"])
    got = {r.session: r for r in some.collect()}
    assert some.columns == ["session", "start", "end", *asked] and set(got) == {"a", "skin"}
    assert got["a"].acc_mean is not None and all(got["skin"][c] is None for c in asked)
    assert list(got.values()) == [r for s in got for r in whole.select(*some.columns).collect() if r.session == s]


def test_recordings_by_a_plain_loop(spark):
    vectors = {1: [0.1 * k for k in range(64)], 2: [0.5, None, 0.25], 3: None}
    table = spark.createDataFrame([(k, v, k) for k, v in vectors.items()], "vec_id bigint, embedding array<float>, label int")
    got = {(r.vec_id, r.name): r["values"] for r in bundle_queries.recordings(lambda t: table, 33).collect()}
    assert set(got) == {(k, name) for k in vectors for name in ("BVP", "EDA", "HR", "ACC")}
    for k, v in vectors.items():
        at = lambda i, v=v: float(np.float32(v[i % 64])) if v and i % 64 < len(v) and v[i % 64] is not None else 0.0
        rate = (k * 3 + 60) / 60
        assert np.array(got[k, "BVP"]) == pytest.approx(np.array([[math.sin(i / 64 * rate * bundle_queries.TURN) + 0.1 * at(i)] for i in range(33 * 64)]), abs=1e-12)
        assert got[k, "ACC"] == [[10 * at(i), 64 + 10 * at(i + 21), 10 * at(i + 42)] for i in range(33 * 32)]
        assert got[k, "HR"] == [[k * 3.0 + 60 + 5 * at(i)] for i in range(23)] and got[k, "EDA"] == [[2.0 + 0.3 * at(i // 8)] for i in range(33 * 4)]
