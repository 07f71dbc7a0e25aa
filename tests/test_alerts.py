"""The alert cases of FIXTURES.md, batch and stream, and random days against a plain loop."""

import datetime as dt
import random

import pytest

from tidemark.operators import alerts as al
from tidemark.operators import explain
from tidemark.plans.stream_queries import as_stream, run_to_end
from tidemark.streaming import live

SCHEMA = "subject_id bigint, day date, carried_frac double, valid boolean, held boolean"
START = dt.date(2024, 1, 1)


def days(spark, rows):
    """rows: (subject, day number, frac, valid, held)."""
    return spark.createDataFrame([(s, START + dt.timedelta(d), f, v, h) for s, d, f, v, h in rows], SCHEMA)


def fired(df):
    return sorted((r.subject_id, (r.day - START).days) for r in df.where("alert").collect())


def run_of(n, frac=0.9, subject=1):
    return [(subject, d, frac, True, False) for d in range(n)]


def test_k_reached(spark):
    assert fired(al.alerts(days(spark, run_of(3)), 0.5, 3)) == [(1, 2)]
    assert fired(al.alerts(days(spark, run_of(3)), 0.5, 4)) == []


def test_gap(spark):
    d = days(spark, [(1, 0, 0.9, True, False), (1, 14, 0.9, True, False), (1, 15, 0.9, True, False)])
    assert fired(al.alerts(d, 0.5, 3)) == []
    assert fired(al.alerts(d, 0.5, 3, max_gap=30)) == [(1, 15)]


def test_resolved_day_breaks(spark):
    d = days(spark, [(1, k, f, True, False) for k, f in enumerate([0.9, 0.9, 0.1, 0.9, 0.9])])
    assert fired(al.alerts(d, 0.5, 3)) == []


def test_refractory(spark):
    d = days(spark, run_of(10))
    assert len(fired(al.alerts(d, 0.5, 3, refractory=7))) == 2
    assert len(fired(al.alerts(d, 0.5, 3, refractory=0))) == 8


def test_subjects_are_apart(spark):
    d = days(spark, run_of(2) + [(2, 2, 0.9, True, False), (2, 3, 0.9, True, False)])
    assert fired(al.alerts(d, 0.5, 3)) == []


def test_held_days_neither_break_nor_extend(spark):
    d = days(spark, [(1, 0, 0.9, True, False), (1, 1, 0.0, True, True), (1, 2, 0.9, True, False), (1, 3, 0.9, True, False)])
    out = al.alerts(d, 0.5, 3)
    assert [r.run_len for r in out.orderBy("day").collect()] == [1, 0, 2, 3]
    assert fired(out) == [(1, 3)]
    assert al.evaluate(out, d.limit(0)).first().observed_days == 4


def test_event_match(spark):
    d = days(spark, run_of(3))
    out = al.evaluate(al.alerts(d, 0.5, 3), d.where("day = '2024-01-03'")).first()
    assert (out.detection_rate, out.alert_precision) == (1.0, 1.0)
    silent = al.evaluate(al.alerts(d, 2.0, 3), d.where("day = '2024-01-03'")).first()
    assert (silent.n_alerts, silent.detection_rate, silent.alert_precision) == (0, 0.0, None)


def loop(rows, limit, k, max_gap, refractory):
    out = []
    for s in sorted({r[0] for r in rows}):
        run, prev, last = 0, None, None
        for _, d, f, v, h in sorted(r for r in rows if r[0] == s):
            if prev is not None and d - prev > max_gap:
                run = 0
            prev = d
            if not v or h:
                continue
            run = run + 1 if f >= limit else 0
            if run >= k and (last is None or d - last >= refractory):
                out.append((s, d))
                last = d
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_days(spark, seed):
    rng = random.Random(seed)
    rows = [(s, d, rng.choice([0.0, 0.9, 0.9]), rng.random() < 0.85, rng.random() < 0.15) for s in range(20) for d in sorted(rng.sample(range(60), 40))]
    for k, gap, ref in ((1, 1, 0), (2, 2, 7), (3, 4, 3)):
        assert fired(al.alerts(days(spark, rows), 0.5, k, gap, ref)) == loop(rows, 0.5, k, gap, ref)
    got = run_to_end(spark, live.alerts(as_stream(spark, days(spark, rows)), 0.5, 2, 2, 7))
    assert fired(got) == loop(rows, 0.5, 2, 2, 7)


def test_chance_keeps_the_number_of_alerts(spark):
    d = al.alerts(days(spark, run_of(20)), 0.5, 3, refractory=5)
    n = len(fired(d))
    assert {r.n_alerts for r in al.chance_level(d, d.limit(0), 5).collect()} == {n}


def test_chance_by_counting(spark):
    """Of 10 valid days 3 are drawn: an event is detected within a day as often as some of the days about it is drawn."""
    import datetime as dt
    from math import comb

    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(s, day(k), k < 3, k != 10) for s in range(30) for k in range(11)] + [(99, day(k), False, True) for k in range(5)]
    d = spark.createDataFrame(rows, "subject_id bigint, day date, alert boolean, valid boolean")
    events = spark.createDataFrame([(s, day(5)) for s in range(30)] + [(s, day(5)) for s in range(30)] + [(0, day(10)), (99, day(2)), (1234, day(2))], "subject_id bigint, day date")
    got = {r.perm: r for r in al.chance_level(d, events, 2000, seed=3, before=1, after=1).collect()}
    assert sorted(got) == list(range(2000)) and {(r.observed_days, r.n_alerts, r.n_events) for r in got.values()} == {(305, 90, 33)}
    one, two = 1 - comb(7, 3) / comb(10, 3), 3 / 10  # days 4 to 6 of 10; the event of day 10 has day 9 alone
    assert sum(r.n_detected for r in got.values()) / 2000 == pytest.approx(30 * one + two, rel=0.01)
    assert sum(r.n_matched for r in got.values()) / 2000 == pytest.approx(30 * 3 * 0.3 + 0.3, rel=0.01)
    apart = {r.perm: r for r in al.chance_level(d.repartition(7), events.repartition(2), 2000, seed=3, before=1, after=1).collect()}
    assert apart == got and {r.perm: r.n_detected for r in al.chance_level(d, events, 50, seed=4).collect()} != {k: got[k].n_detected for k in range(50)}
    assert {r.n_detected for r in al.chance_level(d.where("false"), events, 5).collect()} == {0}


def test_sweep(spark):
    d = days(spark, run_of(4))
    got = {r.k: r.n_alerts for r in al.sweep(d, d.limit(0), [1, 3, 5]).collect()}
    assert got == {1: 1, 3: 1, 5: 0}


def test_ceiling_reopens_and_unknown_z_is_no_deviation(spark):
    d = spark.createDataFrame([(1, 2.5, True, True), (2, 6.0, True, True), (3, None, True, True), (4, 2.5, False, True)], "subject_id bigint, z double, exercise boolean, valid boolean").selectExpr("*", "false as sleep_debt")
    got = {r.subject_id: (r.deviated, r.explained_by, r.carried_frac) for r in explain.apply_explanation(d, caps={"exercise": 3.0}).collect()}
    assert got == {1: (True, "exercise", 0.0), 2: (True, "", 1.0), 3: (False, "", 0.0), 4: (True, "", 1.0)}
