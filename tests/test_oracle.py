"""Every query with SQL gives DuckDB's rows; every other one runs."""

import math
import os

import duckdb
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return [_norm(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    cursor = duck.execute(plans.SQL[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    want = sorted(([_norm(r[cols.index(c)]) for c in order] for r in cursor.fetchall()), key=repr)
    rows = sorted(([_norm(r[c]) for c in order] for r in got.collect()), key=repr)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 0


def test_risk_labels_hold_every_subjects_events(spark, duck):
    events = duck.execute("SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2").fetchall()
    label = {(r.subject_id, r.day): r.label for r in plans.QUERIES["risk_labels"](spark, SF).collect()}
    on = [label[e] for e in events if e in label]
    assert any(s % 7 for s, _ in events) and on and set(on) == {1}
