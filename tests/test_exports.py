"""Zips within zips, exports read in splits, writers and small functions on fixtures."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import metrics
from tidemark.sources import sinks, text, zips


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def test_every_inner_zip_has_a_row(spark, tmp_path):
    """A row a file; what cannot be read, inner or outer, is a row with an error. A partition an inner zip."""
    good = zipped({"EDA.csv": "1594140175\n4.0\n0.5\n", "sub/HR.csv": "x"})
    cut = zipped({"EDA.csv": "1" * 5000})
    outer = {"15/15_1594140175.zip": good, "15/15_200.zip": good, "16/16_bad.zip": b"no zip", "16/16_cut.zip": cut[: len(cut) // 2], "17/17_empty.zip": zipped({}), "readme.txt": "x", "loose_7.zip": good}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/all.zip").write_bytes(zipped(outer))
    (tmp_path / "broken.zip").write_bytes(b"broken")
    (tmp_path / "none.zip").write_bytes(zipped({"readme.txt": "x"}))
    got = zips.read_nested_zips(spark, str(tmp_path))
    rows = {(r.subject_id, r.session, r.t0, r.name, r.text, "unreadable" if r.error and r.error != "empty" else r.error) for r in got.collect()}
    files = [("EDA.csv", "1594140175\n4.0\n0.5\n"), ("sub/HR.csv", "x")]
    want = {(s, n, t, f, c, None) for s, n, t in (("15", "15_1594140175", 1594140175.0), ("15", "15_200", 200.0), (None, "loose_7", 7.0)) for f, c in files}
    want |= {(s, n, None, None, None, e) for s, n, e in (("16", "16_bad", "unreadable"), ("16", "16_cut", "unreadable"), ("17", "17_empty", "empty"), (None, "broken.zip", "unreadable"))}
    assert rows == want and got.count() == len(want)
    assert got.rdd.getNumPartitions() == 7
    assert zips.read_nested_zips(spark, str(tmp_path / "none.zip")).collect() == []
    assert zips.read_nested_zips(spark, f"file://{tmp_path}/a/all.zip").count() == 9


def test_damage_within_an_inner_zip(spark, tmp_path):
    """Files before the damage come; the file in which reading stops gives the error."""
    inner = bytearray(zipped({"a.csv": "fine", "b.csv": "".join(random.Random(1).choices("abcdef", k=4000)), "c.csv": "later"}))
    at = bytes(inner).index(b"b.csv") + 200
    inner[at : at + 50] = b"\0" * 50
    (tmp_path / "all.zip").write_bytes(zipped({"1/1_5.zip": bytes(inner)}))
    got = [(r.name, r.text, r.error is not None) for r in zips.read_nested_zips(spark, str(tmp_path)).collect()]
    assert got[0] == ("a.csv", "fine", False) and got[-1][0] == "b.csv" and got[-1][1] is None and got[-1][2]


def test_one_huge_line_is_read_in_splits(spark, tmp_path):
    """The same rows as of the whole text, on several tasks, wherever the splits fall."""
    rng = random.Random(3)
    records = [f'{{"dateTime": "2020-03-01 10:{k // 60 % 60:02d}:{k % 60:02d}", "value": {{"bpm": {rng.randrange(40, 200)}, "confidence": {k % 4}}}}}' for k in range(4000)]
    whole = "[" + ",".join(records[:2000]) + ', {"dateTime": "2020-03-01 12:00:00", "value": {"steps": 4}},\n ' + ", ".join(records[2000:]) + "]"
    (tmp_path / "hr.json").write_text(whole)
    want = sorted(map(tuple, text.read_heart_rate(spark.createDataFrame([(whole,)], "text string")).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("7001b", "1013b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = text.read_heart_rate_files(spark, str(tmp_path))
            assert sorted(map(tuple, got.collect())) == want and len(want) == 4000
            assert size == "64m" or got.rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_window_tables_are_written_twice(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5, "a"), (2, None, "b")], "k int, x double, s string")
    sinks.write_windows(d, str(tmp_path / "w"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "w/parquet")).collect())) == [(1, 0.5, "a"), (2, None, "b")]
    assert sorted(map(tuple, spark.read.schema(d.schema).option("header", True).csv(str(tmp_path / "w/csv")).collect())) == [(1, 0.5, "a"), (2, None, "b")]


def test_columns_by_name(spark, tmp_path):
    spark.createDataFrame([("1", "x", "2.5")], "a string, b string, c string").write.option("header", True).csv(str(tmp_path / "in"))
    r = text.read_columns(spark, str(tmp_path / "in"), "c double, b double, d int", {"c": "sea"}, ("d",)).first()
    assert r.asDict() == {"sea": 2.5, "b": None, "d": None}
    with pytest.raises(ValueError, match="no column d"):
        text.read_columns(spark, str(tmp_path / "in"), "d int", {})


def test_body_mass_zones(spark):
    got = [r[0] for r in spark.createDataFrame([(18.4,), (18.5,), (22.9,), (23.0,), (25.0,), (None,)], "b double").select(scores.bmi_zone(F.col("b"))).collect()]
    assert got == ["under", "normal", "normal", "over", "obese", None]


def test_directional_error_and_group_split(spark):
    d = spark.createDataFrame([("A", "B"), ("A", "A"), ("A", "C"), ("B", "A"), (None, "B")], "y string, p string")
    assert d.agg(metrics.directional_error(d, "y", "p", "A", "B").alias("e")).first().e == pytest.approx(1 / 3)
    assert d.agg(metrics.directional_error(d, "y", "p", "Z", "B").alias("e")).first().e is None
    some = spark.createDataFrame([(k % 40,) for k in range(200)], "subject_id bigint")
    first = {r.subject_id: r.fold for r in metrics.group_split(some, 4).collect()}
    more = {r.subject_id: r.fold for r in metrics.group_split(some.unionByName(spark.range(100, 120).toDF("subject_id")), 4).collect()}
    assert len(first) == 40 and set(first.values()) == {0, 1, 2, 3} and all(more[s] == f for s, f in first.items()) and len(more) == 60


def test_label_sheets(spark):
    import datetime as dt

    day = lambda d: dt.date(2020, 3, d)
    sheet = spark.createDataFrame(
        [("A1", "COVID-19", "[Timestamp('2020-03-01 00:00:00'), Timestamp('2020-03-01 00:00:00'), Timestamp('2020-03-05 00:00:00')]", "[NaT]", None), ("B", "Other", "[Timestamp('2020-03-02 00:00:00')]", "", ""), (None, "COVID-19", "[Timestamp('2020-03-03 00:00:00')]", "", "")],
        "ParticipantID string, Category string, Symptom_dates string, covid_diagnosis_dates string, recovery_dates string",
    )
    labels = text.label_sheet(sheet)
    assert [tuple(r) for r in labels.orderBy("subject_id").collect()] == [("A1", "COVID-19", [day(1), day(1), day(5)], [], []), ("B", "Other", [day(2)], [], [])]
    assert sorted(map(tuple, text.label_events(labels, "COVID-19").collect())) == [("A1", day(1)), ("A1", day(5))]


def test_tables_are_found_by_name(spark, tmp_path):
    for f in ("b/deep/day.csv", "a/day.csv", "x/lab.csv.bak", "m/minutes/part-0.parquet", "m/minutes/part-1.parquet", "minutes"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    got = {r.name: r.path.split(str(tmp_path))[1] for r in text.find_tables(spark, str(tmp_path), ["day", "lab"], ["minutes"]).collect()}
    assert got == {"day": "/a/day.csv", "minutes": "/m/minutes"}


def test_columns_are_arranged(spark):
    d = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert sinks.arranged(d, ["c", "z", "x"], {"a": "x"}).columns == ["c", "x", "b", "d"] and sinks.arranged(d, ["d"], rest=False).columns == ["d"]
