"""Layouts of files and sheets, pulse intervals by plain loops, the live preview, and the risk model."""

import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tidemark import plans
from tidemark.functions import scores, sentences
from tidemark.operators import alerts, lookups, models
from tidemark.operators import signals as sg
from tidemark.plans.stream_queries import as_stream, run_to_end
from tidemark.sources import layouts, text
from tidemark.streaming import live


def test_zipped_sessions(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("EDA.csv", "1594140175\n4.0\n0.5\n")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("15/15_1594140175.zip", inner.getvalue())
        z.writestr("15/15_bad.zip", b"no zip")
        z.writestr("readme.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"broken")
    got = layouts.read_zipped_sessions(spark, str(tmp_path)).collect()
    assert [(r.subject_id, r.session, r.t0, r.name, r.text) for r in got] == [("15", "15_1594140175", 1594140175.0, "EDA.csv", "1594140175\n4.0\n0.5\n")]


def test_sessions_of_folders(spark, tmp_path):
    for s, files in {"5/5_100": ("BVP", "EDA"), "5/5_x": ("EDA",)}.items():
        (tmp_path / s).mkdir(parents=True)
        for f in files:
            (tmp_path / s / f"{f}.csv").write_text("100\n2.0\n" + "0.5\n" * 8)
    (tmp_path / "5/5_100/IBI.csv").write_text("100, IBI\n1.0,0.8\n3.0,0.9\n")
    listed = {r.session: (r.subject_id, r.session_type, r.t0) for r in layouts.list_sessions(spark, str(tmp_path)).collect()}
    assert listed == {"5_100": ("5", "SHIFT", 100.0), "5_x": ("5", "SHIFT", None)}
    spans = layouts.session_spans(text.read_signals(spark, str(tmp_path))).collect()
    assert [(r.session, r.start, r.end, r.seconds) for r in spans] == [("5_100", 100.0, 104.0, 4.0)]
    bundles = {r.session: r for r in layouts.read_sessions(spark, str(tmp_path)).collect()}
    assert sorted(bundles["5_100"].signals) == ["BVP", "EDA"] and [(b.t, b.ibi) for b in bundles["5_100"].intervals] == [(101.0, 0.8), (103.0, 0.9)]
    assert bundles["5_x"].intervals == [] and bundles["5_x"].tags == [] and bundles["5_x"].signals["EDA"].fs == 2.0


def test_device_files(spark, tmp_path):
    for name in ("A1_hr.csv", "A1_2_hr_longterm.csv", "B_hr.csv", "a_hr.csv", "A1_steps.csv", "A1_hr_old.csv"):
        (tmp_path / name).write_text("datetime,heartrate\n2020-03-01 10:00:00,61\n2020-03-01 10:00:05,x\n")
    got = layouts.read_devices(spark, str(tmp_path), "hr", "datetime timestamp, heartrate double").collect()
    assert sorted((r.subject_id, r.heartrate or 0.0) for r in got) == [("A1", 0.0)] * 2 + [("A1", 61.0)] * 2 + [("B", 0.0), ("B", 61.0)]


def test_sheets_and_marks(spark):
    sheet = spark.createDataFrame([(" S1 ", "3", "x"), ("S2", " 4.5 ", None)], "id string, ` Stroop` string, `Rest ` string")
    out = layouts.numeric_sheet(sheet, "id")
    assert out.columns == ["id", "Stroop", "Rest"] and [tuple(r) for r in out.collect()] == [("S1", 3.0, None), ("S2", 4.5, None)]
    assert sorted(map(tuple, layouts.long_sheet(out, "id").collect())) == [("S1", "Stroop", 3.0), ("S2", "Stroop", 4.5)]
    marks = spark.createDataFrame([(1, "False", "True"), (2, "True", "False"), (3, None, "False"), (4, "False", "False")], "k int, ml_excluded string, flagged string")
    assert [r.k for r in layouts.usable_rows(marks).collect()] == [1, 4]
    assert [r.k for r in layouts.usable_rows(marks, drop_flagged=True).collect()] == [4]
    assert layouts.usable_rows(marks.select("k")).count() == 4


def test_frame_logs(spark):
    d = spark.createDataFrame([("0  2023-11-13 14:10:51.500\n\n1  2023-11-13 14:10:51.750\n2\n3  2023-11-13 14:10:52.500", "71.5  0.03\n72  0.04\n")], "meta string, ppg string")
    r = d.select(layouts.frame_seconds(F.col("meta")).alias("t"), layouts.frame_values(F.col("ppg")).alias("v")).first()
    assert r.t == pytest.approx([0, 0.25, 1.0]) and r.v == [71.5, 72.0]


def test_particles_follow_the_last_syllable(spark):
    words = ["카페인", "음주", "운동(달리기)", "수면(잠)", "coffee", "", "("]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in d.select(sentences.particle(F.col("w"), "이", "가")).collect()]
    assert got == ["카페인이", "음주가", "운동(달리기)이", "수면(잠)이", "coffee가", "가", "(가"]


def test_fixed_tables(spark):
    d = spark.createDataFrame([("S2",), ("S14",), (None,)], "s string")
    assert [r[0] for r in d.select(lookups.looked_up(F.col("s"), {"S2": 1}, 0)).collect()] == [1, 0, 0]
    assert [r[0] for r in d.where("s is not null").select(lookups.fixed_split(F.col("s"), {"train": ("S2",), "val": ("S14",)})).collect()] == ["train", "val"]
    with pytest.raises(Exception, match="in no split"):
        d.select(lookups.fixed_split(F.col("s"), {"train": ("S2",)})).collect()


def test_complexion_without_known_frames(spark):
    d = spark.createDataFrame([([[1.0, 2.0, float("nan")]], [[1.0, 2.0, 3.0]]), ([], []), (None, None)], "f array<array<double>>, c array<array<double>>")
    rows = d.select(*[v.alias(n) for n, v in scores.complexion(F.col("f"), F.col("c")).items()]).collect()
    assert all(v is None for r in rows for v in r)


def test_complexion_of_halves(spark, tmp_path):
    """Colours halfway between two numbers are rounded as in SQL, which reckons in the table's floats."""
    import duckdb

    rng = np.random.default_rng(5)
    values = (rng.integers(-80, 80, (60, 64)) + 0.5) / 100
    vectors = [(k, [float(v) for v in np.float32(row)]) for k, row in enumerate(values)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(plans.SQL["complexion"]).fetchall()}
    got = {r[0]: r[1:] for r in plans.QUERIES["complexion"](spark, str(tmp_path)).select("vec_id", "a_rel", "a_cheek", "s_rel", "rg_rel").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


def test_rhythm_against_plain_loops():
    """The cubic and the local peaks by their definitions, one sample at a time."""
    rng = np.random.default_rng(3)
    x = np.sin(np.arange(120) / 30 * 2 * np.pi * 1.2) + 0.1 * rng.normal(size=120)
    at = lambda k: x[min(max(k, 0), len(x) - 1)]
    want = []
    for j in range(int(119 / 30 * 250) + 1):
        t = j * 30 / 250
        i, u = int(t), t - int(t)
        a, b, c, d = at(i - 1), at(i), at(i + 1), at(i + 2)
        want.append(b + u / 2 * (c - a + u * (2 * a - 5 * b + 4 * c - d + u * (3 * (b - c) + d - a))))
    y = sg.upsample(x, 30, 250)
    assert y == pytest.approx(want)
    near, found = 100, []
    for i in range(1, len(y) - 1):
        if y[i] > y[i - 1] and y[i] >= y[i + 1]:
            rise = y[i] - max(y[max(0, i - near) : i + 1].min(), y[i : i + near + 1].min())
            if rise >= 0.3 * y.std():
                found.append((rise, i))
    kept = []
    for _, i in sorted(found, key=lambda f: -f[0]):
        if all(abs(i - k) >= near for k in kept):
            kept.append(i)
    assert sg.local_peaks(y, near, 0.3).tolist() == sorted(kept)


def test_rhythm_leaves_out_holes():
    t = np.arange(0, 30, 1 / 30)
    pulse = np.sin(2 * np.pi * t)
    whole, known = sg.rhythm(pulse, 30, 60), np.ones(len(t), bool)
    known[300:315] = False
    holed = sg.rhythm(pulse, 30, 60, known)
    assert whole["n_rr"] - holed["n_rr"] in (1, 2) and holed["pairs"] < holed["n_rr"] - 1 and holed["mean_rr"] == pytest.approx(1000, abs=5)
    assert sg.rhythm(np.zeros(90), 30, float("nan"))["n_rr"] == 0


@pytest.mark.parametrize("name", ["pulse_rhythm", "ecg_features", "short_scans"])
def test_planted_rates(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    bpm = np.array([60000 / r.mean_rr if name == "pulse_rhythm" else r.hr for r in rows], float)
    off = np.abs(bpm - np.array([60 + 3 * r.label for r in rows]))
    assert len(rows) > 100 and np.median(off) < 1 and (off < 3).mean() > 0.9
    if name == "short_scans":
        assert all(8 <= r.seconds <= 20 and (r.early or r.seconds == 20) for r in rows) and np.median([r.seconds for r in rows]) < 15


def test_other_stages_of_a_scan(spark):
    from tests.test_scans import camera

    d = camera(spark, 1, 72).groupBy("scan").agg(F.array_sort(F.collect_list(F.struct(*sg.SAMPLE))).alias("s")).select("scan", *[F.col(f"s.{c}").alias(c) for c in sg.SAMPLE])
    plain = sg.scan_figures(d, ["scan"]).first()
    other = sg.scan_figures(d, ["scan"], extract=lambda rgb, fs: rgb[:, 1] - rgb[:, 1].mean(), fuse=lambda pulses, fs: pulses[0]).first()
    assert plain.bpm == pytest.approx(72, abs=2) and other.bpm == pytest.approx(72, abs=2) and other.snr != plain.snr


def test_preview_needs_valid_seconds_and_goes_blank(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)

    def rows(scan, a, b, skip=lambda t: False):
        ts = [k / 10 for k in range(int(a * 10), int(b * 10))]
        return [(scan, start + dt.timedelta(seconds=t), [100.0, 90 + float(np.sin(2 * np.pi * 1.25 * t)), 80.0]) for t in ts if not skip(t)]

    schema = "scan bigint, ts timestamp, rgb array<double>"
    s = as_stream(spark, spark.createDataFrame(rows(1, 0, 12) + rows(2, 0, 6) + rows(3, 0, 14, lambda t: 8 < t < 9.5), schema))
    got = {r.scan: (r.t - start.timestamp(), r.bpm) for r in run_to_end(spark, live.preview(s, lambda t, c: (75.0, float(len(t))))).collect() if r.bpm is not None or r.scan > 1}
    assert got[1] == (pytest.approx(11.9), 75.0) and got[2][1] is None and got[3][1] is None


def test_a_stale_preview_is_blank_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    schema = "scan bigint, ts timestamp, rgb array<double>"
    part = lambda scan, a, b: spark.createDataFrame([(scan, start + dt.timedelta(seconds=k / 10), [1.0, 2.0, 3.0]) for k in range(a * 10, b * 10)], schema)
    for name, d in (("1", part(1, 0, 12)), ("2", part(2, 12, 20)), ("3", part(2, 20, 30))):
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_to_end(spark, live.preview(stream, lambda t, c: (75.0, 1.0))).where("scan = 1").collect()
    assert sorted((r.bpm or 0.0) for r in got) == [0.0, 75.0] and {round(r.t - start.timestamp(), 1) for r in got} == {11.9}


def test_risk_model(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(30):
        for k in range(20):
            y = None if k % 5 == 4 else int(rng.random() < 0.3)
            x = float(rng.normal((y or 0) * 2))
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=k), k % 7 != 6, None if k == 3 else x, float(rng.normal()), y))
    d = spark.createDataFrame(rows, "subject_id int, day date, valid boolean, a double, b double, label int")
    got = models.risk_out_of_fold(d, ["a", "b"], 3).collect()
    assert len(got) == len(rows) and {(r.subject_id, r.day) for r in got if r.p is None} == {(r[0], r[1]) for r in rows if not r[2] or r[3] is None}
    assert any(r.label is None and r.p is not None for r in got)
    fold = {r.subject_id: r.fold for r in got}
    p1, p0 = ([r.p for r in got if r.label == y and r.p is not None] for y in (1, 0))
    assert np.mean(np.array(p1)[:, None] > np.array(p0)) > 0.85
    f = fold[0]  # one fold by plain Newton steps: half the squared weights plus the weighted losses of the other subjects
    train = [r for r in rows if fold[r[0]] != f and r[2] and r[3] is not None and r[5] is not None]
    x = np.array([[1.0, r[3], r[4]] for r in train])
    y = np.array([r[5] for r in train])
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (q - y)) + ridge @ beta)
    for r in [g for g in got if g.fold == f and g.p is not None][:40]:
        a, b = next((v[3], v[4]) for v in rows if v[0] == r.subject_id and v[1] == r.day)
        assert r.p == pytest.approx(1 / (1 + np.exp(-(beta @ [1, a, b]))), abs=1e-4)


def test_matched_cut(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=10 * k), True, float(k + s)) for s in range(3) for k in range(5)]
    d = spark.createDataFrame(rows, "subject_id int, day date, valid boolean, z double")
    other = spark.createDataFrame([(k < 6,) for k in range(20)], "alert boolean")
    r = alerts.matched(d, "z", [1.0, 2.0, 3.0, 4.0, 5.0], other).first()
    want = min((abs(sum(x[3] >= c for x in rows) - 6), c) for c in (1.0, 2.0, 3.0, 4.0, 5.0))
    assert (r.cut, r.target) == (want[1], 6) and r.n_alerts == sum(x[3] >= r.cut for x in rows)


def test_a_subject_in_two_kinds_of_session(spark, tmp_path):
    """Folders of one name below two kinds are two sessions; the parts of a split recording are one subject's."""
    for folder, t0 in {"STRESS/S01": 100, "AEROBIC/S01": 500, "STRESS/S11_a": 100, "STRESS/S11_b": 300}.items():
        (tmp_path / folder).mkdir(parents=True)
        for name in ("EDA", "BVP"):
            (tmp_path / folder / f"{name}.csv").write_text(f"{t0}\n2.0\n" + "0.5\n" * 8)
        (tmp_path / folder / "IBI.csv").write_text(f"{t0}, IBI\n1.0,0.8\n")
        (tmp_path / folder / "tags.csv").write_text(f"{t0 + 5}\n{t0 + 2}\n")
    (tmp_path / "STRESS/readme.txt").write_text("x")
    bundles = {(r.session_type, r.session): r for r in layouts.read_sessions(spark, str(tmp_path)).collect()}
    assert sorted(bundles) == [("AEROBIC", "S01"), ("STRESS", "S01"), ("STRESS", "S11_a"), ("STRESS", "S11_b")]
    for (kind, folder), t0 in {("STRESS", "S01"): 100.0, ("AEROBIC", "S01"): 500.0, ("STRESS", "S11_b"): 300.0}.items():
        r = bundles[kind, folder]
        assert r.signals["EDA"].t0 == t0 and r.tags == [t0 + 2, t0 + 5] and [(b.t, b.ibi) for b in r.intervals] == [(t0 + 1, 0.8)]
    assert (bundles["STRESS", "S11_b"].subject_id, bundles["STRESS", "S11_b"].part, bundles["STRESS", "S01"].part) == ("S11", "b", "")
    spans = {(r.session_type, r.session): (r.start, r.end) for r in layouts.session_spans(text.read_signals(spark, str(tmp_path))).collect()}
    assert spans["STRESS", "S01"] == (100.0, 104.0) and spans["AEROBIC", "S01"] == (500.0, 504.0) and len(spans) == 4
    found = sorted((r.session_type, r.session, r.subject_id, r.part, r.n_files) for r in layouts.discover_sessions(spark, str(tmp_path)).collect())
    assert found == [("AEROBIC", "S01", "S01", "", 4), ("STRESS", "S01", "S01", "", 4), ("STRESS", "S11_a", "S11", "a", 4), ("STRESS", "S11_b", "S11", "b", 4)]
    merged = {(r.session_type, r.subject_id, r.name): [p.t0 for p in r.pieces] for r in layouts.merged_parts(text.read_signals(spark, str(tmp_path))).collect()}
    assert merged["STRESS", "S11", "EDA"] == [100.0, 300.0] and merged["STRESS", "S01", "BVP"] == [100.0]


def test_features_from_session_folders(spark, tmp_path):
    """From files to the feature bundle: discovered sessions, their tags as segments, windows, features."""
    from tidemark.operators import bundle
    from tidemark.operators.windows import sliding_windows

    for kind, level in {"STRESS": 80, "AEROBIC": 120}.items():
        (tmp_path / kind / "S01").mkdir(parents=True)
        (tmp_path / kind / "S01/HR.csv").write_text("1000\n1.0\n" + "".join(f"{level + k % 2}\n" for k in range(200)))
        (tmp_path / kind / "S01/ACC.csv").write_text("1000\n4.0\n" + "0,0,64\n" * 800)
        (tmp_path / kind / "S01/tags.csv").write_text("1010\n1130\n")
    spans = text.read_tags(spark, str(tmp_path)).select("session_type", "session", F.get("tags", F.lit(0)).alias("start"), F.get("tags", F.lit(1)).alias("end"))
    windows = sliding_windows(spans, 60.0, 30.0).select("session_type", "session", F.col("t0").alias("start"), F.col("t1").alias("end"))
    got = bundle.window_features(text.read_signals(spark, str(tmp_path)), windows, text.SESSION).collect()
    assert len(got) == 6 and {(r.session_type, r.hr_mean, r.acc_mean) for r in got} == {("STRESS", 80.5, 1.0), ("AEROBIC", 120.5, 1.0)} and all(r.ibi_mean is None for r in got)
