"""Window bundles, breathing, vitals and the staged judgement of scans by plain loops and planted rates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tests.test_scans import camera
from tidemark import plans
from tidemark.operators import bundle, scans
from tidemark.operators import signals as sg

SIGNALS = "session string, name string, t0 double, fs double, values array<array<double>>"


def recording(seed, seconds=150):
    rng = np.random.default_rng(seed)
    t = np.arange(seconds * 64) / 64
    return {
        "BVP": (1000.0, 64.0, np.sin(2 * np.pi * 1.2 * t + np.sin(t / 7)) + rng.normal(0, 0.05, len(t))), "EDA": (1000.4, 4.0, 2 + np.cumsum(rng.normal(0, 0.02, seconds * 4))),
        "HR": (1010.0, 1.0, 70 + rng.normal(0, 3, seconds - 10)), "ACC": (999.75, 32.0, rng.normal(0, 20, (seconds * 32, 3)) + [0, 0, 64]),
    }


def as_rows(session, signals):
    return [(session, name, t0, fs, [[float(v) for v in np.atleast_1d(s)] for s in x]) for name, (t0, fs, x) in signals.items()]


def plain(signals, start, end):
    """The bundle by loops over samples; beats, bands and skin responses by the kernels that have tests of their own."""
    cut = {n: (fs, [x[k] for k in range(len(x)) if t0 + k / fs >= start - 1e-9 and k < math.floor((end - t0) * fs)]) for n, (t0, fs, x) in signals.items()}
    sd = lambda v: math.sqrt(sum((a - sum(v) / len(v)) ** 2 for a in v) / (len(v) - 1))
    avg = lambda v: sum(v) / len(v) if len(v) else 0.0
    out = {}

    def trend(prefix, v, fs):
        out[f"{prefix}_ratio_up"] = avg([(b - a) * fs for a, b in zip(v, v[1:], strict=False) if b > a])
        out[f"{prefix}_ratio_down"] = avg([(b - a) * fs for a, b in zip(v, v[1:], strict=False) if b < a])

    fs, v = cut["HR"]
    out |= {"hr_mean": avg(v), "hr_std": sd(v)}
    trend("hr", v, fs)
    fs, v = cut["ACC"]
    size = [math.sqrt(sum((c / 64) ** 2 for c in s)) for s in v]
    for k, axis in enumerate("xyz"):
        out |= {f"{axis}_mean": avg([s[k] / 64 for s in v]), f"{axis}_std": sd([s[k] / 64 for s in v])}
    out |= {"acc_mean": avg(size), "acc_std": sd(size), "acc_dyn_mean": avg([abs(m - float(np.median(size))) for m in size])}
    trend("acc", size, fs)
    fs, v = cut["BVP"]
    out |= {"bvp_mean": avg(v), "bvp_std": sd(v)}
    at = sg.pulse_peaks(sg.zero_phase(np.array(v), fs, 0.5, 10.0, 4), fs) / fs
    beats = [(b - a, b) for a, b in zip(at, at[1:], strict=False) if 0.3 <= b - a <= 1.5]
    middle = float(np.median([i for i, _ in beats]))
    beats = [(i, t) for i, t in beats if abs(i - middle) <= 0.3 * middle]
    ibi = [i for i, _ in beats]
    steps = [(b - a) * 1000 for a, b in zip(ibi, ibi[1:], strict=False)]
    out |= {"ibi_mean": avg(ibi), "ibi_max": max(ibi), "ibi_min": min(ibi), "hr_from_ibi": 60 / avg(ibi), "rmssd": math.sqrt(avg([s * s for s in steps])), "sdnn": sd(ibi) * 1000}
    out |= {"pnn20": 100 * avg([abs(s) > 20 for s in steps]), "pnn50": 100 * avg([abs(s) > 50 for s in steps]), "n_beats": len(ibi)}
    out |= sg.interval_bands(np.array(ibi), np.array([t for _, t in beats]))
    fs, v = cut["EDA"]
    clean = sg.zero_phase(np.array(v), fs, None, 1.0, 4)
    tonic = sg.zero_phase(clean, fs, None, 0.05, 2)
    for name, part in (("raw", clean), ("tonic", tonic), ("phasic", clean - tonic)):
        out |= {f"mean_{name}_eda": avg(part), f"std_{name}_eda": sd(part)}
    trend("tonic", list(tonic), fs)
    found = sg.skin_responses(clean - tonic, fs)
    out |= {"peaks_density": len(found) / (len(v) / fs) * 60, "mean_amplitude": avg([e["amplitude"] for e in found]), "mean_onset_sample": avg([e["onset"] for e in found])}
    return out | {"mean_peak_sample": avg([e["peak"] for e in found]), "mean_risetime": avg([e["rise"] for e in found]), "mean_recoverytime": avg([e["recovery"] for e in found])}


def test_bundle_equals_a_plain_loop(spark):
    sessions = {"a": recording(1), "b": recording(2)}
    rows = [r for s, signals in sessions.items() for r in as_rows(s, signals)]
    windows = [(s, a, a + 60, "seg") for s in sessions for a in (1003.3, 1020.0, 1085.13)]
    got = bundle.window_features(spark.createDataFrame(rows, SIGNALS), spark.createDataFrame(windows, "session string, start double, end double, segment string"), ["session"])
    assert got.columns == ["session", "start", "end", "segment", *bundle.FEATURES] and len(bundle.FEATURES) == 52
    found = {(r.session, r.start): r.asDict() for r in got.collect()}
    assert len(found) == 6
    for s, a, b, _ in windows:
        want = plain(sessions[s], a, b)
        assert set(want) == set(bundle.FEATURES)
        assert {k: found[s, a][k] for k in want} == {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items()}, (s, a)


def test_bundle_of_what_is_missing(spark):
    full = recording(3)
    rows = as_rows("no_eda", {k: v for k, v in full.items() if k != "EDA"}) + as_rows("short", {k: (t0, fs, x[: int(20 * fs)]) for k, (t0, fs, x) in full.items()}) + as_rows("alone", full)
    rows += [("parts", "HR", 1000.0, 1.0, [[float(k)] for k in range(30)]), ("parts", "HR", 1040.0, 1.0, [[float(k)] for k in range(100, 130)]), ("parts", "HR", None, 1.0, [[1.0]]), ("parts", "TEMP", 1000.0, 4.0, [[30.0]]), ("null", "HR", 1000.0, 1.0, None)]
    windows = [("no_eda", 1020.0, 1080.0), ("short", 1060.0, 1120.0), ("parts", 1000.0, 1060.0), ("parts", 1045.0, 1060.0), ("parts", None, 1060.0), ("null", 1000.0, 1060.0), ("nobody", 0.0, 60.0)]
    got = bundle.window_features(spark.createDataFrame(rows, SIGNALS), spark.createDataFrame(windows, "session string, start double, end double"), ["session"]).collect()
    found = {(r.session, r.start): r for r in got}
    assert set(found) == {w[:2] for w in windows if w[0] not in ("nobody", "null")}
    r = found["no_eda", 1020.0]
    assert all(r[c] is None for c in bundle.SKIN) and r.hr_mean is not None and r.n_beats > 50
    assert all(found["short", 1060.0][c] is None for c in bundle.FEATURES) and all(found["parts", None][c] is None for c in bundle.FEATURES)
    assert (found["parts", 1000.0].hr_mean, found["parts", 1045.0].hr_mean) == (14.5, 112.0) and found["parts", 1045.0].acc_mean is None


def test_bundle_of_sessions_that_cross_batches(spark):
    """Numbers may come in one array; sessions meet their windows whatever the batches, also those without a name."""
    full = {s: recording(k, 70) for k, s in enumerate(("a", None, "c"))}
    rows = [(s, name, t0, fs, np.ravel(x).tolist()) for s, signals in full.items() for name, (t0, fs, x) in signals.items()]
    windows = [(s, a, a + 60) for s in (*full, "nobody") for a in (1003.3, 1005.0, 1008.5)]
    nested, wide = spark.createDataFrame([r for s, signals in full.items() for r in as_rows(s, signals)], SIGNALS), spark.createDataFrame(rows, "session string, name string, t0 double, fs double, values array<double>")
    grid = spark.createDataFrame(windows, "session string, start double, end double")
    want = {(r.session, r.start): r for r in bundle.window_features(nested, grid, ["session"]).collect()}
    assert len(want) == 9 and all(r.n_beats > 50 and r.acc_mean > 0 for r in want.values())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        got = bundle.window_features(wide, grid, ["session"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 9
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "session"} == pytest.approx({k: v for k, v in want[r.session, r.start].asDict().items() if k != "session"}, rel=1e-9, abs=1e-12)


def test_recordings_by_plain_formulas(spark, monkeypatch):
    from tidemark.plans import bundle_queries as bq

    read = lambda table: spark.read.parquet(f"{SF}/{table}.parquet").where("vec_id < 30")
    given = {r.vec_id: r for r in read("embeddings").collect()}
    for few in (bq.FEW, 0):
        monkeypatch.setattr(bq, "FEW", few)
        rows = bq.recordings(read).collect()
        assert len(rows) == 4 * len(given)
        for r in rows:
            e, label = given[r.vec_id].embedding, given[r.vec_id].label
            want = {
                "BVP": [math.sin(k / 64 * ((label * 3 + 60) / 60) * bq.TURN) + 0.1 * e[k % 64] for k in range(64 * 130)], "EDA": [2.0 + 0.3 * e[k // 8 % 64] for k in range(4 * 130)],
                "HR": [label * 3.0 + 60 + 5 * e[k % 64] for k in range(120)], "ACC": [v for k in range(32 * 130) for v in (10 * e[k % 64], 64 + 10 * e[(k + 21) % 64], 10 * e[(k + 42) % 64])],
            }[r.name]
            assert len(r["values"]) == len(want) and np.abs(np.array(r["values"]) - np.array(want)).max() < 1e-9


def test_planted_rates_of_the_bundle(spark):
    rows = plans.QUERIES["window_bundle"](spark, SF).collect()
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(rows) == 3 * len(labels) and all(r.hr_from_ibi == pytest.approx(60 + 3 * labels[r.vec_id], abs=1.5) for r in rows)


# -- breathing ---------------------------------------------------------------------------------------------
def nod(rate, seed, seconds=30):
    rng, t = np.random.default_rng(seed), np.arange(seconds * 30) / 30
    wave = np.sin(2 * np.pi * rate / 60 * t + rng.uniform(0, 6)) if rate else np.zeros(len(t))
    return 0.4 + 0.004 * wave + 0.0005 * np.cumsum(rng.normal(size=len(t))) / 5 + rng.normal(0, 0.002, len(t)), 100 + 0.3 * wave + rng.normal(0, 0.3, len(t)), t


def test_breathing_is_found_and_not_made_up():
    rates = np.linspace(10, 26, 100)
    found = [sg.breath_of_two(*nod(rate, k)[:2], 30.0)["breaths"] for k, rate in enumerate(rates)]
    assert np.mean([b is not None and abs(b - rate) <= 1 for b, rate in zip(found, rates, strict=True)]) >= 0.9
    assert np.mean([sg.breath_of_two(*nod(None, 1000 + k)[:2], 30.0)["breaths"] is None for k in range(200)]) >= 0.95


def test_breathing_needs_both_sources_and_time():
    head, light, _ = nod(15, 1)
    assert sg.breath_of_two(head, nod(22, 2)[1], 30.0)["breaths"] is None
    r = sg.breath_of_two(head, light, 30.0)
    assert r["breaths"] == pytest.approx((r["head_breaths"] + r["light_breaths"]) / 2) and sg.breath_of_two(head[:440], light[:440], 30.0) == {}


def test_a_drift_at_the_band_edge_is_no_breath():
    t = np.arange(900) / 30
    rate, rise = sg.breath_peak(np.sin(2 * np.pi * 0.14 * t) * 5 + np.sin(2 * np.pi * 0.3 * t), 30.0)
    assert rate == pytest.approx(18, abs=0.5) and rise > 10


def test_breathing_query(spark):
    for r in plans.QUERIES["scan_breathing"](spark, SF).collect():
        assert r.head_breaths == pytest.approx(10 + r.label, abs=0.8)
        assert (r.breaths is None) == (r.vec_id % 2 == 1) or r.label <= 0, r


def test_vitals_of_a_breathing_face():
    """A deterministic face: pulse 75 with the rate and height following a breath of 15 a minute."""
    t, w = np.arange(900) / 30, 2 * math.pi * 0.25
    phase = 2 * math.pi * 1.25 * (t - 0.06 / w * np.cos(w * t) + 0.06 / w)
    p = (1 + 0.15 * np.sin(w * t)) * (np.sin(phase) + 0.3 * np.sin(2 * phase - 0.5))
    rest = 2 * np.sin(2 * math.pi * 0.05 * t) + 0.3 * np.sin(w * t)
    m = sg.scan_vitals_of(t, np.stack([150 + 0.15 * p + rest, 110 + 0.5 * p + rest, 90 + 0.1 * p + rest], 1))
    assert (m["signal"], m["beats"], m["irregular"], m["rr_conf"]) == ("high", 38, False, "high")
    assert m["hr"] == pytest.approx(75.6, abs=0.15) and m["rr"] == pytest.approx(14.8, abs=0.15) and m["rmssd"] == pytest.approx(21.3, abs=0.15)
    assert m["sdnn"] == pytest.approx(18.1, abs=1.0) and m["si"] == pytest.approx(682.6, rel=0.06)  # the filters differ at the scan's ends


def test_beat_figures_by_cases():
    ragged = 0.8 + np.random.default_rng(1).choice([-0.22, 0.0, 0.22], size=40)
    assert sg.beat_figures(np.concatenate([[0], np.cumsum(ragged)]))["jumps"] > 0.3
    missed = np.concatenate([np.full(20, 0.8), [2.0], np.full(20, 0.8)])
    assert not sg.usable_intervals(missed)[20] and sg.usable_intervals(missed).sum() == 40
    assert "rmssd" not in sg.beat_figures(np.arange(6) * 0.8) and sg.beat_figures(np.zeros(0))["beats"] == 0


def test_vitals_query(spark):
    rows = plans.QUERIES["scan_vitals"](spark, SF).collect()
    assert all(r.hr == pytest.approx(60 + 3 * r.label, abs=1.0) and r.signal == "high" and r.irregular is not True for r in rows)


# -- amplitudes and rhythm -----------------------------------------------------------------------------------
@pytest.mark.parametrize(("n", "rate"), [(450, 1.15), (300, 1.0), (4, 1.0), (3, 1.0), (450, float("nan"))])
def test_amplitude_by_a_plain_loop(n, rate):
    x = 0.03 * np.sin(2 * np.pi * 1.0 * np.arange(n) / 30) + 0.2
    mean, re, im, weight, spread = sum(x) / n, 0.0, 0.0, 0.0, 0.0
    for i in range(n):
        w = 0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))
        re, im = re + w * (x[i] - mean) * math.cos(2 * math.pi * rate * i / 30), im + w * (x[i] - mean) * math.sin(2 * math.pi * rate * i / 30)
        weight, spread = weight + w, spread + (x[i] - mean) ** 2 / n
    want = (2 * math.hypot(re, im) / weight, min(1.0, 2 * (math.hypot(re, im) / weight) ** 2 / spread)) if n >= 4 and math.isfinite(rate) else (0.0, 0.0)
    assert sg.amplitude_at(x, 30.0, rate) == pytest.approx(want)
    if (n, rate) == (450, 1.15):
        assert want[0] < 0.001  # a movement beside the pulse is none at it


def test_rhythm_without_a_rate_allows_a_faster_pulse():
    """Peaks may lie the period of 1.6 times 90 apart, not of 1.6 times 75: a pulse of 130 keeps its beats."""
    x = np.sin(2 * np.pi * 130 / 60 * np.arange(900) / 30)
    r = sg.rhythm(x, 30.0, float("nan"))
    assert r["mean_rr"] == pytest.approx(60_000 / 130, rel=0.02)


# -- the cascade -----------------------------------------------------------------------------------------------
def test_only_failures_go_on(spark, monkeypatch):
    """Cancelling is asked for failures alone, and windows are laid for what still fails."""
    d = camera(spark, 1, 72.0, noise=0.05).unionByName(camera(spark, 2, 84.0, still=lambda t: t < 22, noise=0.05)).unionByName(camera(spark, 3, 66.0, still=lambda t: False))
    seen, plain_figures = [], sg.scan_figures

    def figures(units, keys, fs, cancelled):
        seen.append((len(keys), cancelled, sorted({r.scan for r in units.select("scan").collect()})))
        return plain_figures(units, keys, fs, cancelled)

    monkeypatch.setattr(sg, "scan_figures", figures)
    got = {r.scan: r for r in scans.judge_scans(d, ["scan"]).collect()}
    assert seen == [(1, False, [1, 2, 3]), (1, True, [2, 3]), (2, False, [2, 3]), (2, True, [2, 3])]
    assert got[1].method == "fused" and got[1].hrv_reliable and got[1].mean_rr == pytest.approx(60_000 / 72, rel=0.02) and got[1].pairs >= 20
    assert got[2].method.endswith("+window") and not got[2].hrv_reliable and got[2].pairs < 20 and got[2].breaths is None
    assert (got[3].passed, got[3].reason, got[3].hrv_reliable) == (False, "brightness", False)


def test_breathing_goes_with_the_scan(spark):
    t = F.col("t")
    nodding = camera(spark, 5, 72.0, noise=0.05).withColumn("y", F.col("y") + 0.4 * F.sin(t * (2 * math.pi * 16 / 60)))
    lit = [F.transform(c, lambda v: v * (1 + 0.003 * F.sin(t * (2 * math.pi * 16 / 60)))).alias(c) for c in ("forehead", "left", "right")]
    r = scans.judge_scans(nodding.select(*[c for c in nodding.columns if c not in ("forehead", "left", "right")], *lit), ["scan"]).first()
    assert r.passed and r.breaths == pytest.approx(16, abs=0.8)


# -- first phase -----------------------------------------------------------------------------------------------
def test_first_phase_by_plain_loops(spark):
    t = np.arange(60 * 64) / 64
    x = np.sin(2 * np.pi * 1.25 * t) + 0.02 * np.random.default_rng(1).normal(size=len(t))
    r = bundle.first_pulse(x, 64.0)
    assert r["HR_mean"] == pytest.approx(75, abs=0.5) and r["bvp_quality"] == 1 and r["HR_min"] <= r["HR_mean"] <= r["HR_max"] and r["n_ibi"] in (73, 74)
    assert bundle.first_pulse(x[:600], 64.0) == {"n_ibi": 0, "bvp_quality": 0} and bundle.first_pulse(np.zeros(1000), 64.0)["n_ibi"] == 0
    assert bundle.steady_intervals(np.array([800.0, 1000, 810, 500, 790, 800])).tolist() == [800, 810, 790, 800] and bundle.steady_intervals(np.array([1.0, 9.0])).tolist() == [1, 9]
    eda = 2 + np.where(np.arange(240) % 60 == 30, 0.5, 0.0)
    s = bundle.first_skin(eda, 4.0)
    assert s["SCR_count"] == 4 and 0.02 < s["SCR_mean_amplitude"] < 0.5 and s["EDA_mean"] == pytest.approx(eda.mean(), abs=0.01) and bundle.first_skin(eda[:19], 4.0) == {}


def test_first_phase_query(spark):
    rows = plans.QUERIES["first_phase"](spark, SF).collect()
    assert all(r.HR_mean == pytest.approx(60 + 3 * r.label, abs=1.5) and r.bvp_quality == 1 and r.TEMP_slope == pytest.approx(0.01, abs=0.002) and r.ACC_energy > 0 and r.EDA_mean is not None for r in rows)
