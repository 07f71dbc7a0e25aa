"""Queries without SQL: streams against batch rows below the watermark, signals against their planted rates, draws by their counts."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest

from tests.test_oracle import SF, TABLES
from tests.test_oracle import duck as duck  # noqa: PLC0414
from tests.test_oracle import pytestmark as pytestmark  # noqa: PLC0414
from tidemark import plans
from tidemark.operators import metrics, models
from tidemark.operators import signals as sg

assert TABLES


def rows_of(spark, name):
    return plans.QUERIES[name](spark, SF).collect()


def test_streamed_days_are_the_batch_days_that_the_watermark_closed(spark, duck):
    batch = {(s, d): (n, c) for s, d, n, c in duck.execute("SELECT user_id, CAST(ts AS DATE), count(*), count(*) FILTER (value > 50) FROM events GROUP BY ALL").fetchall()}
    last = max(d for _, d in batch)
    got = {(r.subject_id, r.day): (r.n_windows, r.n_carried) for r in rows_of(spark, "stream_day_fold")}
    assert got and all(batch[k] == v for k, v in got.items())
    assert {k for k in batch if k[1] < last - dt.timedelta(days=3)} <= set(got)


def test_streamed_sessions_are_gaps_of_six_hours(spark, duck):
    times = {}
    for s, t in duck.execute("SELECT user_id, ts FROM events ORDER BY ts").fetchall():
        times.setdefault(s, []).append(t)
    want = Counter()
    for s, ts in times.items():
        start, n = ts[0], 0
        for a, b in zip(ts, [*ts[1:], None], strict=True):
            n += 1
            if b is None or b - a > dt.timedelta(hours=6):
                want[s, start, n] += 1
                start, n = b, 0
    got = plans.QUERIES["stream_sessions"](spark, SF)
    start, count = next(c for c in got.columns if "start" in c), next(c for c in got.columns if c.startswith("n"))
    some = Counter((r.subject_id, r[start].replace(tzinfo=None), r[count]) for r in got.collect())
    newest = max(ts[-1] for ts in times.values())
    assert some and not some - want
    assert all(k in some for k in want if max(t for t in times[k[0]] if t >= k[1]) < newest - dt.timedelta(hours=8) and k[1] == max(x[1] for x in want if x[0] == k[0]))


def test_streamed_alerts_are_the_batch_alerts(spark):
    batch = {(r.subject_id, r.day) for r in rows_of(spark, "alerts_k") if r.alert}
    assert {(r.subject_id, r.day) for r in rows_of(spark, "stream_alerts") if r.alert} == batch and batch


@pytest.mark.parametrize(("name", "rate"), [("pos_hr", "hr"), ("scan_hr", "hr"), ("fused_hr", "bpm"), ("welch_bands", "hr")])
def test_planted_rates_are_found(spark, name, rate):
    rows = rows_of(spark, name)
    off = np.array([abs(r[rate] - (60 + 3 * r.label)) for r in rows])
    assert len(rows) > 100 and np.median(off) < 2 and (off < 5).mean() > 0.8


def test_judged_scans(spark):
    rows = rows_of(spark, "scan_judgement")
    assert len({r.vec_id for r in rows}) == len(rows) > 100
    assert {r.reason is None for r in rows if r.passed} == {True} and all(r.reason for r in rows if not r.passed)
    good = [r for r in rows if r.passed]
    assert len(good) > 0.5 * len(rows) and np.median([abs(r.bpm - 60 - 3 * r.label) for r in good]) < 2 and {r.method for r in good} <= {"fused", "fused+motion"}


def test_skin_responses_by_a_plain_search(spark):
    """Numbers and mean sizes of the responses, from the kernel's own filtered signal by a plain climb and descent."""
    got = {r.vec_id: r for r in rows_of(spark, "skin_responses")}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(20).collect():
        x = np.repeat(2.0 + np.array(r.embedding, float), 8)
        clean = sg.zero_phase(x, 4.0, None, 1.0, 4)
        tonic = sg.zero_phase(clean, 4.0, None, 0.05, 2)
        p = clean - tonic
        tops = [k for k in range(1, len(p) - 1) if p[k] > p[k - 1] and p[k] >= p[k + 1]]
        kept = []
        for k in sorted(tops, key=lambda k: -p[k]):
            if all(abs(k - o) >= 4 for o in kept):
                kept.append(k)
        sizes = []
        for k in kept:
            lowest = []
            for step in (-1, 1):  # down to where the signal is higher than the peak
                at, low = k, p[k]
                while 0 <= at < len(p) and p[at] <= p[k]:
                    low, at = min(low, p[at]), at + step
                lowest.append(low)
            if p[k] - max(lowest) < 0.01:
                continue
            a = k
            while a > 0 and p[a] >= p[a - 1]:
                a -= 1
            if p[k] - p[a] >= 0.01:
                sizes.append(p[k] - p[a])
        assert got[r.vec_id].mean_tonic == pytest.approx(tonic.mean(), abs=1e-3)
        assert got[r.vec_id].n_scr == len(sizes) and got[r.vec_id].mean_amplitude == pytest.approx(np.mean(sizes), abs=1e-3)


def test_band_passed_power_and_beats(spark):
    for r in rows_of(spark, "bandpass_peaks"):
        assert r.power == pytest.approx(0.5, abs=0.1) and abs(r.n - (60 + 3 * r.label)) <= 6


def test_cancelled_noise(spark):
    rows = rows_of(spark, "nlms_cancel")
    assert len(rows) > 100 and all(r.before == pytest.approx(4.5, rel=0.05) and r.after < 0.25 * r.before for r in rows)


def test_chance_keeps_each_subjects_number(spark):
    alerts = sum(r.alert for r in rows_of(spark, "alerts_k"))
    rows = rows_of(spark, "chance_level")
    assert {r.n_alerts for r in rows} == {alerts} and len({r.perm for r in rows}) == len(rows) == 2000
    assert all(0 <= r.detection_rate <= 1 for r in rows)
    chance = rows_of(spark, "chance_summary")[0]
    seen = rows_of(spark, "alert_eval")[0]
    assert chance.detection_rate == pytest.approx(seen.detection_rate, abs=1e-4) and chance.chance_detection_rate == pytest.approx(sum(r.detection_rate for r in rows) / 2000, abs=1e-4)
    assert chance.p_detection == pytest.approx(sum(r.detection_rate >= seen.detection_rate - 1e-9 for r in rows) / 2000, abs=1e-9)


def test_random_drop_keeps_numbers(spark):
    got = plans.QUERIES["random_drop"](spark, SF)
    assert got.count() > 0 and all(v is not None for v in got.first())
    again = plans.QUERIES["random_drop"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_out_of_fold_counts(spark, duck):
    days = duck.execute("SELECT count(*) FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events)").fetchone()[0]
    rows = rows_of(spark, "model_out_of_fold")
    assert sum(r.n_test for r in rows) == days and len(rows) == 3 and all(0.3 < r.accuracy <= 1 for r in rows)


def test_exact_signed_ranks(spark):
    """Against every pattern of signs, written out."""
    rng = np.random.default_rng(6)
    for n in (5, 9, 12):
        d = rng.permutation(np.arange(1, n + 1)) * rng.choice([-1.0, 1.0], n)
        r = metrics.wilcoxon(spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double"), "a", "b").first()
        least = min(d[d > 0].sum(), -d[d < 0].sum())
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n)]
        assert r.p_value == pytest.approx(min(1.0, 2 * sum(s <= least for s in sums) / 2**n))


def test_ranks_with_an_outlier(spark):
    """Percentiles and AUC over values of which one is far off, and with many ties."""
    from tidemark.operators import baselines

    rng = np.random.default_rng(7)
    v = [*np.round(rng.normal(0, 1, 3000), 2).tolist(), 1e12, -1e9, *[0.5] * 500]
    y = rng.random(len(v)) < 0.3
    d = spark.createDataFrame([(k, float(a), bool(b)) for k, (a, b) in enumerate(zip(v, y, strict=True))], "k int, x double, y boolean")
    a = np.array(v)
    got = {r.k: r.score for r in baselines.global_percentile(d, "x").collect()}
    assert all(got[k] == pytest.approx(((a < v[k]).mean() - 0.5) * 4) for k in range(0, len(v), 37)) and got[3000] == pytest.approx(((a < 1e12).mean() - 0.5) * 4)
    from pyspark.sql import functions as F

    p, n = a[y], a[~y]
    assert metrics.auc(d, "x", F.col("y")).first().auc == pytest.approx(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))


def test_split_summary_sees_leaks(spark):
    d = spark.createDataFrame([(s, "AB"[k % 2]) for s in range(9) for k in range(4)], "subject_id bigint, label string")
    assert {r.leak for r in metrics.split_summary(models.with_folds(d, folds=3)).collect()} == {False}
    assert {r.leak for r in metrics.split_summary(models.with_folds(d, "random", folds=2)).collect()} <= {True, False}


@pytest.mark.parametrize("name", ["text_sleep", "text_daily_value"])
def test_exports_hold_many_users(spark, name, tmp_path, monkeypatch):
    """An export's files grow with users by the fifty, not one by one."""
    import glob

    from tidemark.plans import text_queries

    rows = [(u, dt.datetime(2024, 1, 1 + u % 9, 12), "view", 60.0) for u in range(200)]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(text_queries, "shared", lambda _: f"{tmp_path}/export")
    assert plans.QUERIES[name](spark, str(tmp_path)).count() == (200 if name == "text_sleep" else 9)
    assert len(glob.glob(f"{tmp_path}/export/*.txt")) == 4
