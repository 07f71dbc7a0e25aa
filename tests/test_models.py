"""Fold fits by complement and by one aggregate a step, against one fit after another."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tidemark import plans
from tidemark.operators import explain, facts, metrics, models


def fitted_one_by_one(rows, grid, default):
    """Each fold's cut by a loop over the other folds' rows."""
    out = {}
    for f in {r[0] for r in rows}:
        known = [(s, y) for g, s, y in rows if g != f and s is not None]
        pos, neg = sum(y for _, y in known), sum(not y for _, y in known)
        best = (-2.0, 0.0)
        for c in sorted(grid):
            if len(known) >= 10 and pos and neg:
                j = round(sum(s > c and y for s, y in known) / pos - sum(s > c and not y for s, y in known) / neg, 12)
                best = max(best, (j, -c))
        out[f] = -best[1] if best[0] > -2 else default
    return out


@pytest.mark.parametrize("subjects", [4, 60])
def test_cuts_by_complement(spark, subjects):
    """The same cuts as fold by fold, also with a fold for each subject and a fold without a score."""
    rng = np.random.default_rng(subjects)
    rows = [(s, None if rng.random() < 0.1 or s == 1 else float(np.round(rng.normal(), 2)), bool(rng.random() < 0.4)) for s in range(subjects) for _ in range(12)]
    rows = [(s, None if x is None else x + y, y) for s, x, y in rows]
    d = spark.createDataFrame([(f, s, y) for f, s, y in rows], "fold int, s_HR_HIGH double, y boolean")
    grid = [k / 4 for k in range(-6, 9)]
    got = {r.fold: r.cut_HR_HIGH for r in facts.cross_fitted(d, "fold", None, "HR_HIGH", F.col("y"), grid, 0.5).collect()}
    assert got == fitted_one_by_one(rows, grid, 0.5) and len(got) == subjects
    some = {r.fold: r.cut_HR_HIGH for r in facts.cross_fitted(d, "fold", [0, 2], "HR_HIGH", F.col("y"), grid, 0.125).collect()}
    assert some[0] == got[0] and some[3] == 0.125


def test_candidates_count_every_row(spark):
    rows = [(k % 3, (k * 7 % 20) / 4, k % 4 == 0) for k in range(200)] + [(0, None, True)]
    d = spark.createDataFrame(rows, "g int, s double, y boolean")
    for at_least in (False, True):
        got = {(r._g0, r.cut): (r.n, r.tp, r.fp, r.n_pos, r.n_neg) for r in facts.candidates(d, "s", F.col("y"), [2.0, 0.0, 4.75], [F.col("g")], at_least).collect()}
        for (g, c), want in got.items():
            own = [(s, y) for h, s, y in rows if h == g and s is not None]
            hit = [y for s, y in own if (s >= c if at_least else s > c)]
            assert want == (len(own), sum(hit), len(hit) - sum(hit), sum(y for _, y in own), sum(not y for _, y in own))
        assert len(got) == 9


def labelled(seed=1, subjects=14, days=30):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(subjects):
        for k in range(days):
            y = int(rng.random() < 0.3) if s != 5 else None
            a = float(rng.normal() + (y or 0) * 1.5)
            out.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=k), k % 9 != 4, None if k == 7 else a, float(rng.normal()), y if k % 5 else None))
    return out


def test_every_subject_a_fold(spark):
    """Leave-one-subject-out in a dozen aggregates: the same as one Newton fit after another."""
    rows = labelled()
    d = spark.createDataFrame(rows, "subject_id int, day date, valid boolean, a double, b double, label int")
    got = models.risk_out_of_fold(d, ["a", "b"], how="loso").collect()
    assert len(got) == len(rows) and {r.subject_id == r.fold for r in got} == {True}
    by = defaultdict(list)
    for r in got:
        by[r.fold].append(r)
    for f in (0, 3, 5, 13):
        train = [r for r in rows if r[0] != f and r[2] and r[3] is not None and r[5] is not None]
        x, y = np.array([[1.0, r[3], r[4]] for r in train]), np.array([r[5] for r in train])
        w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
        beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-x @ beta))
            beta -= np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (q - y)) + ridge @ beta)
        own = {r[1]: r for r in rows if r[0] == f}
        for r in by[f]:
            _, _, valid, a, b, _ = own[r.day]
            assert (r.p is None) == (not valid or a is None)
            assert r.p is None or r.p == pytest.approx(1 / (1 + np.exp(-(beta @ [1, a, b]))), abs=1e-8)
    assert any(r.p is not None for r in by[5])  # without labels of its own it is predicted by a model of all the others
    one_kind = d.withColumn("label", F.when(F.col("subject_id") == 2, 1).otherwise(0))
    with pytest.raises(ValueError, match="one kind"):
        models.risk_out_of_fold(one_kind, ["a", "b"], how="loso")


@pytest.mark.parametrize("shift", [0.0, 40.0])
def test_many_folds_by_the_loss_polynomial(spark, shift):
    """More folds than are fitted by passes: the same models, also where a subject far off moves its own a lot, and no state of folds x folds."""
    rows = [(s, y, a + (shift if s == 3 else 0.0), b) for s, _, valid, a, b, y in labelled(7, 150, 20) if valid and a is not None and y is not None]
    train = spark.createDataFrame(rows, "s int, y int, a double, b double")
    many, every = models.logistic_by_fold(train, "s", ["a", "b"], "y", block=40)
    plain, same = models.logistic_by_fold(train, "s", ["a", "b"], "y", block=1000)
    want, got = ({r[0]: r[1] for r in d.collect()} for d in (plain, many))
    assert every == pytest.approx(same, abs=1e-9) and got.keys() == want.keys() and len(got) == 149
    assert all(got[s] == pytest.approx(want[s], abs=1e-8) for s in want)


def test_polynomial_knows_where_it_ends():
    """A model of all rows but a few is proved exact where little is left out, and is not where much is."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(3000, 2)), (rng.random(3000) < 0.4).astype(int)
    full, total = np.concatenate([np.ones((3000, 1)), x], axis=1), np.bincount(y, minlength=2).astype(float)

    def newton(keep):
        w, beta, ridge = (total - np.bincount(y[~keep], minlength=2)), np.zeros(3), np.diag([0.0, 1.0, 1.0])
        w = (w.sum() / (2 * w))[y[keep]]
        for _ in range(40):
            q = 1 / (1 + np.exp(-full[keep] @ beta))
            beta = beta - np.linalg.solve((full[keep] * (w * q * (1 - q))[:, None]).T @ full[keep] + ridge, full[keep].T @ (w * (q - y[keep])) + ridge @ beta)
        return beta

    loss = models.LossPolynomial(newton(np.ones(3000, bool)), np.array([1.0, *np.sqrt((x**2).mean(0))]))
    frame = pd.DataFrame({"_y": y, "a": x[:, 0], "b": x[:, 1]})
    sums = np.array(next(loss.sums(iter([frame]), ["a", "b"]))["sums"].tolist())
    n = len(loss.powers)
    for left, proved in ((np.arange(3000) < 10, True), ((x[:, 0] > -0.5) & (y == 1), False)):
        beta, sure = loss.without(x[left], y[left], total, loss.derivatives(sums[:, :n]), sums[:, n:], 1.0, 25, 1e-9)
        assert sure == proved and (not sure or beta == pytest.approx(newton(~left), abs=1e-8))


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=5000), np.round(rng.normal(size=3000)), np.array([2.5]), np.array([1.0, 4.0])):
        got = models.quantiles_by_rank(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v", (0.0, 0.5, 0.97, 1.0))
        assert got == pytest.approx(np.quantile(values, [0.0, 0.5, 0.97, 1.0]).tolist(), abs=1e-12)
    assert models.quantiles_by_rank(spark.createDataFrame([(None,)], "v double"), "v", (0.5,)) is None


def test_levels_are_quantiles_of_quiet_days(spark):
    rows = [(k, 0, k / 1000) for k in range(1000)] + [(2000, 1, 0.95), (2001, None, 0.975), (2002, 1, None), (2003, 1, 0.5)]
    got = {r.k: r.level for r in models.risk_levels(spark.createDataFrame(rows, "k int, label int, p double")).collect()}
    assert (got[2000], got[2001], got[2002], got[2003]) == (1, 2, None, 0)
    assert sum(got[k] >= 1 for k in range(1000)) == 100 and sum(got[k] == 3 for k in range(1000)) == 10


def test_risk_query(spark):
    rows = plans.QUERIES["risk_out_of_fold"](spark, SF).collect()
    assert rows and all((r.p is None) == (r.level is None) and (r.p is None or 0 <= r.p <= 1) for r in rows)
    assert {r.level for r in rows} >= {0} and any(r.p is not None for r in rows)


def test_other_models_and_their_importance(spark):
    """Forest and network tell two clear classes apart, out of fold; the forest names the feature that does it."""
    rng = np.random.default_rng(0)
    rows = [(s, float(rng.normal() + 4 * (k % 2)), float(rng.normal()), "B" if k % 2 else "A") for s in range(12) for k in range(10)]
    d = models.with_folds(spark.createDataFrame(rows, "subject_id bigint, a double, b double, label string"), folds=2)
    for kind in ("forest", "mlp"):
        p = models.out_of_fold(d, kind, ["a", "b"])
        assert metrics.class_metrics(p, "label", "pred_label", ["A", "B"]).first().accuracy > 0.9, kind
    model = models.classifier("forest", ["a", "b"]).fit(models.weighted(d))
    (first, share), (second, _) = models.importance(model, ["a", "b"])
    assert (first, second) == ("a", "b") and share > 0.7


@pytest.mark.parametrize(("folds", "n"), [(5, 40), (60, 12), (3, 1)])
def test_quantiles_of_the_other_folds(spark, folds, n):
    """The quantile of all other folds' values, fold by fold, with ties, unknown values and a fold for each subject."""
    rng = np.random.default_rng(folds)
    rows = [(g, f, None if rng.random() < 0.05 else float(np.round(rng.normal() * (1 + f % 3), 1))) for g in ("a", "b") for f in range(folds) for _ in range(int(rng.integers(0, n + 1)) + (f == 0))]
    got = {(r.g, r.f): (r.cap, r.n) for r in explain.others_quantile(spark.createDataFrame(rows, "g string, f int, z double"), "g", "f", "z", 0.95, 20).collect()}
    want = {}
    for g, f in {(g, f) for g, f, z in rows if z is not None}:
        others = [z for h, e, z in rows if h == g and e != f and z is not None]
        want[g, f] = (pytest.approx(float(np.quantile(others, 0.95)), abs=1e-9) if len(others) >= 20 else None, len(others))
    assert got == want
