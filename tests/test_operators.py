"""Small fixtures for baselines, intervals, arrays, sources, signals and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, scores
from tidemark.operators import baselines, folds, intervals, metrics, models, signals, windows
from tidemark.plans.stream_queries import as_stream, run_to_end
from tidemark.session import clean_nans
from tidemark.sources import text
from tidemark.streaming import live


def series(spark, values, valid=None):
    valid = valid or [True] * len(values)
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(k), v, ok) for k, (v, ok) in enumerate(zip(values, valid, strict=True))]
    return spark.createDataFrame(rows, "subject_id bigint, day date, x double, valid boolean")


def z_of(df):
    return [r.z for r in baselines.rolling_z(df).orderBy("day").collect()]


def test_rolling_z_needs_history_and_sees_no_future(spark):
    v = [50.0 + (k * 7) % 5 for k in range(60)]
    z = z_of(series(spark, v))
    assert all(a is None for a in z[:21]) and all(a is not None for a in z[21:])
    changed = z_of(series(spark, v[:40] + [999.0] * 20))
    assert changed[:40] == z[:40]
    lagged = z_of(series(spark, [*v[:33], *[999.0] * 7, *v[40:]]))
    assert lagged[40] == pytest.approx(z[40])  # the last seven days are no reference


def test_rolling_z_against_numpy(spark):
    rng = np.random.default_rng(1)
    v, ok = rng.normal(60, 5, 50).round(2).tolist(), (rng.random(50) < 0.9).tolist()
    for k, z in enumerate(z_of(series(spark, v, ok))):
        ref = np.array([v[j] for j in range(max(0, k - 35), max(0, k - 7)) if ok[j]])
        if not ok[k] or len(ref) < 14:
            assert z is None
        else:
            assert z == pytest.approx((v[k] - np.median(ref)) / (1.4826 * np.median(np.abs(ref - np.median(ref)))))


def test_constant_history_has_no_z(spark):
    assert z_of(series(spark, [50.0] * 40))[-1] is None


def test_partitions_do_not_matter(spark):
    d = series(spark, [50.0 + (k * 7) % 5 for k in range(60)])
    assert z_of(d.repartition(1)) == z_of(d.repartition(17))


def test_nan_is_unknown(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r.x for r in clean_nans(d).collect()] == [1.0, None, None]


def test_day_fold(spark):
    rows = [("A", k < 5) for k in range(10)] + [("B", k < 50) for k in range(100)] + [("C", True)] * 3
    got = {r.subject_id: (r.n_carried, r.carried_frac, r.valid) for r in folds.fold_days(spark.createDataFrame(rows, "subject_id string, carried boolean").withColumn("day", F.lit("2024-01-01").cast("date"))).collect()}
    assert got == {"A": (5, 0.5, True), "B": (50, 0.5, True), "C": (3, 1.0, False)}


def test_night_belongs_to_the_waking_day(spark):
    rows = [(1, dt.datetime(2020, 3, 1, 23, 0), 60.0), (1, dt.datetime(2020, 3, 2, 1, 0), 62.0), (1, dt.datetime(2020, 3, 2, 2, 0), 64.0), (1, dt.datetime(2020, 3, 2, 3, 0), 0.0)]
    got = folds.fold_nights(spark.createDataFrame(rows, "subject_id bigint, ts timestamp, hr double"), F.lit(True)).collect()
    assert [(str(r.day), r.night_hr, r.night_min) for r in got] == [("2020-03-02", 62.0, 3)]


def test_spans_are_half_open(spark):
    p = spark.createDataFrame([(1, t) for t in (5.0, 10.0, 20.0, 35.0, 40.0)], "subject_id bigint, t double")
    s = spark.createDataFrame([(1, 10.0, 20.0), (1, 30.0, 40.0)], "subject_id bigint, start double, end double")
    assert [r.inside for r in intervals.within_span(p, s).orderBy("t").collect()] == [False, True, False, True, False]


def test_nearest_without_events(spark):
    p = spark.createDataFrame([(1, 60.0), (2, 60.0)], "subject_id bigint, t double")
    e = spark.createDataFrame([(1, 180.0, 200.0)], "subject_id bigint, start double, end double")
    assert {r.subject_id: r.minutes for r in intervals.minutes_to_nearest(p, e).collect()} == {1: 2.0, 2: None}


def test_windows(spark):
    s = spark.createDataFrame([(1, 0.0, 30.0), (2, 0.0, 120.0)], "id int, start double, end double")
    got = [(r.id, r.t0, r.t1) for r in windows.sliding_windows(s, 60.0, 30.0).orderBy("id", "t0").collect()]
    assert got == [(1, 0.0, 30.0), (2, 0.0, 60.0), (2, 30.0, 90.0), (2, 60.0, 120.0)]


def test_slices(spark):
    d = spark.createDataFrame([([float(k) for k in range(10)],)], "v array<double>")
    got = d.select(windows.slice_between(F.col("v"), 2.0, F.lit(0.0), F.lit(0.6), F.lit(2.4)).alias("a"), windows.slice_between(F.col("v"), 2.0, F.lit(0.0), F.lit(0.6), F.lit(2.4), "round").alias("b")).first()
    assert (got.a, got.b) == ([2.0, 3.0], [1.0, 2.0, 3.0, 4.0])


def test_arrays(spark):
    d = spark.createDataFrame([([0.8, 0.8, 1.6, 0.8],), ([],), ([1.0],)], "v array<double>")
    got = d.select(arrays.median(F.col("v")).alias("m"), arrays.rmssd(F.col("v")).alias("r"), arrays.clean_intervals(F.col("v")).alias("c"), arrays.quantile(F.col("v"), 0.9).alias("q")).collect()
    assert got[0].c == [0.8, 0.8, 0.8] and got[0].m == 0.8 and got[0].q == pytest.approx(np.quantile([0.8, 0.8, 1.6, 0.8], 0.9))
    assert (got[1].m, got[1].r, got[1].q, got[2].r, got[2].m) == (None, None, None, None, 1.0)


def test_scores(spark):
    d = spark.range(1).select(scores.health_score(F.lit(20.0), F.lit(None).cast("double"), F.lit(80.0), F.lit(None).cast("double")).alias("h"), scores.life_score(F.lit(6.0), F.lit(3.0), F.lit(4.0)).alias("l"), *[c.alias(n) for c, n in zip(scores.lab(F.lit(255.0), F.lit(255.0), F.lit(255.0)), "Lab", strict=True)])
    r = d.first()
    assert r.h == pytest.approx(80.0) and r.l == pytest.approx((85 + 60 + 80) / 3)
    assert r.L == pytest.approx(100.0, abs=0.01) and abs(r.a) < 0.01 and abs(r.b) < 0.02


def test_wilcoxon(spark):
    d = spark.createDataFrame([(float(a), float(b)) for a, b in ((125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145))], "a double, b double")
    r = metrics.wilcoxon(d, "a", "b").first()
    assert (r.n, r.n_nonzero, r.r_plus, r.r_minus) == (10, 9, 27.0, 18.0)
    assert r.p_value == pytest.approx(0.593, abs=0.01)


def test_signals_find_the_rate(spark):
    fs, t = 30.0, np.arange(900) / 30
    for bpm in (58.2, 72.0, 94.8):
        p = np.sin(2 * np.pi * bpm / 60 * t)
        rgb = np.stack([120 + 0.3 * p, 90 + 0.8 * p, 80 + 0.5 * p], 1)
        assert signals.strongest(signals.pulse_v1(rgb, fs), fs)[0] == pytest.approx(bpm, abs=0.7)
        assert signals.strongest(signals.pulse_v2(rgb, fs), fs)[0] == pytest.approx(bpm, abs=0.7)


def test_zero_phase_keeps_the_band_and_drops_the_rest():
    t = np.arange(1200) / 20
    slow, kept = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 2 * t)
    y = signals.zero_phase(slow + kept, 20.0, 1.0, 5.0, 4)
    assert np.abs(y - kept)[100:-100].max() < 0.02


def test_find_peaks():
    x = np.array([0, 1, 0, 3, 2.9, 3.1, 0, 0.2, 0.0])
    assert signals.find_peaks(x).tolist() == [1, 3, 5, 7]
    assert signals.find_peaks(x, 3).tolist() == [1, 5] or signals.find_peaks(x, 3).tolist() == [5]
    assert signals.find_peaks(x, 1, 0.5).tolist() == [1, 5]


def test_breathing_and_short_scans(spark):
    t = np.arange(0, 60, 0.1)
    rr, share = signals.breathing(t, np.sin(2 * np.pi * 0.25 * t))
    assert rr == pytest.approx(15, abs=0.5) and share > 0.8
    d = spark.createDataFrame([(1, [0.0, 1.0], [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]), (2, None, None)], "id int, t array<double>, rgb array<array<double>>")
    assert [r.hr for r in signals.scan_features(d, ["id"], "t", "rgb").collect()] == [None, None]


def test_sources(spark, tmp_path):
    for s in ("S11_a", "S12"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "EDA.csv").write_text("2020-01-01 00:00:00\n4.0\n0.1\n0.2\n")
        (tmp_path / s / "ACC.csv").write_text("1577836800.0,1577836800.0,1577836800.0\n32.0,32.0,32.0\n1,2,3\n4,5,6\n")
        (tmp_path / s / "IBI.csv").write_text("1577836800.0, IBI\n1.0,0.8\nbad\n2.0,0.9\n")
        (tmp_path / s / "tags.csv").write_text("1577836900\n1577836850\n")
    (tmp_path / "S12" / "HR.csv").write_text("1577836800\n")
    got = {(r.session, r.name): (r.subject_id, r.t0, r.fs, r["values"]) for r in text.read_signals(spark, str(tmp_path)).collect()}
    assert got[("S11_a", "EDA")] == ("S11", 1577836800.0, 4.0, [[0.1], [0.2]])
    assert got[("S12", "ACC")][3] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]] and ("S12", "HR") not in got
    assert sorted(r.ibi for r in text.read_intervals(spark, str(tmp_path)).where("session = 'S12'").collect()) == [0.8, 0.9]
    assert text.read_tags(spark, str(tmp_path)).first().tags == [1577836850.0, 1577836900.0]


def test_surveys(spark):
    d = spark.createDataFrame([("06/11/2019", "Yes"), ("06/11/2019", "No"), ("07/11/2019", "I don't want to say"), ("07/11/2019", "No")], "date string, drank string")
    assert {str(r.day): r.drank for r in text.any_yes_per_day(d, "date", "drank", "drank").collect()} == {"2019-11-06": True, "2019-11-07": False}
    c = spark.createDataFrame([("[Timestamp('2020-03-01 00:00:00'), Timestamp('2020-03-09 00:00:00')]",), ("[NaT]",)], "c string")
    assert [len(r[0]) for r in c.select(text.listed_dates(F.col("c"))).collect()] == [2, 0]
    s = spark.createDataFrame([("2020-03-08", "23:30", "01:00")], "d string, a string, b string")
    r = text.survey_intervals(s, "d", "a", "b", "America/Chicago").first()
    assert r.end_s - r.start_s == 5400


def test_import_nights(spark):
    d = spark.createDataFrame([("Date;HR;Sleep",), ("2024-01-01;61;7.5",), ("2024/01/02;400;420",), ("x;60;400",), ("2024-01-03;59;420",)], "value string")
    kept, counts = text.import_nights(spark, d)
    assert sorted(r.asleep for r in kept.collect()) == [420.0, 450.0]
    assert counts.first().asDict() == {"n": 2, "skipped": 2}


def test_labels_around_events(spark):
    d = series(spark, [0.0] * 80)
    got = {(r.day - dt.date(2024, 1, 1)).days: r.label for r in models.label_around(d, d.where("day = '2024-02-10'")).collect()}
    assert got[40] == 1 and got[35] == 1 and got[42] == 1 and got[34] is None and got[43] is None and got[18] == 0 and got[69] == 0


def test_streams(spark):
    rows = [(1, dt.datetime(2024, 1, d, h), 1.0, d == 1) for d in (1, 2, 3) for h in (1, 2, 3)]
    s = as_stream(spark, spark.createDataFrame(rows, "subject_id bigint, ts timestamp, value double, carried boolean"))
    got = {str(r.day): (r.n_windows, r.n_carried, r.valid) for r in run_to_end(spark, live.fold_days(s, min_windows=3)).collect()}
    assert got == {"2024-01-01": (3, 3, True), "2024-01-02": (3, 0, True)}
    e = as_stream(spark, spark.createDataFrame([(1, float(t), 70.0 + (t < 11) * 9 * (t % 2), 4.0) for t in range(8, 20)], "scan bigint, t double, bpm double, snr double"))
    assert [(r.scan, r.bpm) for r in run_to_end(spark, live.early_stop(e)).collect()] == [(1, 70.0)]
    a = as_stream(spark, spark.createDataFrame([(1, t / 10, 5 <= t < 30) for t in range(60)], "scan bigint, t double, ok boolean"))
    assert [(r.t, r.aligned) for r in run_to_end(spark, live.steady(a)).orderBy("t").collect()] == [(1.5, True), (3.3, False)]


def test_early_stop_compares_with_the_latest_and_asks_the_gates(spark):
    est = lambda rows: as_stream(spark, spark.createDataFrame(rows, "scan bigint, t double, bpm double, snr double, passed boolean"))
    rows = [(1, 10.0, 70.0, 5.0, True), (1, 11.0, 72.0, 5.0, True), (1, 12.0, 74.0, 5.0, True), (1, 13.0, 74.0, 5.0, True)]  # 70, 72, 74 is too wide
    rows += [(2, 10.0, 70.0, 5.0, True), (2, 11.0, 70.0, -5.0, True), (2, 12.0, 70.0, 5.0, True)]  # an earlier weak one does not matter
    rows += [(3, 10.0, 70.0, 5.0, True), (3, 11.0, 70.0, 5.0, True), (3, 12.0, 70.0, 5.0, False), (3, 13.0, 70.0, 5.0, True)]  # the gates wait
    rows += [(4, 10.0, 70.0, 5.0, True), (4, 11.0, None, 5.0, True), (4, 12.0, 70.0, 5.0, True), (4, 13.0, 70.0, 2.0, True)]
    got = {r.scan: r.t for r in run_to_end(spark, live.early_stop(est(rows))).collect()}
    assert got == {1: 13.0, 2: 12.0, 3: 13.0}


def test_resampling_by_the_definition():
    rng = np.random.default_rng(3)
    t, x = np.cumsum(rng.random(50)), rng.random((50, 3))
    got = signals.resample(t, x, 7.0)
    assert len(got) == int((t[-1] - t[0]) * 7)
    for k, row in enumerate(got):
        at = t[0] + k / 7
        j = max(i for i in range(49) if t[i] <= at)
        assert row == pytest.approx(x[j] + (x[j + 1] - x[j]) * (at - t[j]) / (t[j + 1] - t[j]))
    assert signals.known_at(np.array([0.0, 0.1, 1.1, 1.2]), 10.0).tolist() == [True, *[False] * 10, True][:11] + [True] * (int(1.2 * 10) - 11)


def test_bands_of_a_modulated_heart():
    at = np.cumsum(np.full(400, 0.8))
    got = signals.interval_bands(0.8 + 0.05 * np.sin(2 * np.pi * 0.1 * at) + 0.02 * np.sin(2 * np.pi * 0.25 * at), at)
    power = lambda size, f: size**2 / 2 * np.sinc(0.8 * f) ** 4  # noqa: E731  what linear interpolation leaves of a sine
    assert got["LF_power"] == pytest.approx(power(0.05, 0.1), rel=0.05) and got["HF_power"] == pytest.approx(power(0.02, 0.25), rel=0.05)
    assert (got["LF_peak"], got["HF_peak"]) == (pytest.approx(0.1, abs=0.01), pytest.approx(0.25, abs=0.01))
    assert got["LF_n"] + got["HF_n"] == pytest.approx(1) and got["LF_HF_ratio"] == pytest.approx(got["LF_power"] / got["HF_power"])
    assert signals.interval_bands(np.full(29, 0.8), np.arange(29) * 0.8) == {}


def test_second_estimator():
    fs, n = 30.0, 600
    x = np.sin(2 * np.pi * 1.2 * np.arange(n) / fs) + 0.02 * np.arange(n)
    d = np.diff(np.eye(n), 2, axis=0)
    assert signals.smooth_detrend(x) == pytest.approx(x - np.linalg.solve(np.eye(n) + 1e4 * d.T @ d, x), abs=1e-8)
    bpm, snr = signals.spectrum_peak(x, fs)
    assert bpm == pytest.approx(72, abs=1.8) and snr > 5 and (bpm / 60 * 1024 / fs) == pytest.approx(round(bpm / 60 * 1024 / fs))
    # windows of the ceiling's length, without the last one
    rgb = 100 + np.random.default_rng(1).random((70, 3))
    w, out = int(np.ceil(1.6 * 29.0)), np.zeros(70)
    for m in range(70 - w):
        c = rgb[m : m + w] / rgb[m : m + w].mean(0)
        a, b = c[:, 1] - c[:, 2], c[:, 1] + c[:, 2] - 2 * c[:, 0]
        h = a + a.std() / b.std() * b
        out[m : m + w] += h - h.mean()
    assert signals.plane_orthogonal(rgb, 29.0, "v2") == pytest.approx(out)


def test_scan_peak_and_its_half():
    fs, t = 30.0, np.arange(600) / 30
    assert signals.scan_peak(np.sin(2 * np.pi * 1.37 * t), fs)[0] == pytest.approx(82.2, abs=0.1)
    slow = 0.7 * np.sin(2 * np.pi * 0.85 * t) + np.sin(2 * np.pi * 1.7 * t)
    assert signals.scan_peak(slow, fs)[0] == pytest.approx(51, abs=0.5)  # half the strongest rate
    assert signals.amplitude_at(3 * np.sin(2 * np.pi * 1.5 * t), fs, 1.5) == (pytest.approx(3, abs=0.05), pytest.approx(1, abs=0.02))
    noise = np.random.default_rng(2).normal(0, 3, 600)
    clear = np.sin(2 * np.pi * 1.2 * t)
    joined = signals.fused([clear, clear + noise], fs)
    assert signals.scan_peak(joined, fs)[1] > signals.scan_peak((clear + clear + noise) / 2, fs)[1]
