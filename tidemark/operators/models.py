"""Splits and pyspark.ml models over feature tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ranges
from tidemark.session import written


def with_folds(df: DataFrame, how: str = "group", folds: int = 5, subject: str = "subject_id", label: str = "label", seed: int = 0) -> DataFrame:
    """`df` with a fold: `group` (a subject's rows together), `loso` (the subject is the fold), `random` (stratified rows)."""
    if how == "loso":
        return df.withColumn("fold", F.col(subject))
    if how == "random":
        order = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *df.columns)))
        return df.withColumn("fold", (order % folds).cast("bigint"))
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(subject).cast("string")), F.lit(folds)).cast("bigint"))


def subject_split(df: DataFrame, test_share: float = 0.3, seed: int = 0, subject: str = "subject_id") -> DataFrame:
    """`df` with is_test: about the share of subjects, by a seeded hash."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), F.col(subject).cast("string")), F.lit(10_000)) < F.lit(int(test_share * 10_000)))


def classifier(kind: str, features: list[str], label: str = "label", classes: int = 2, seed: int = 0) -> Pipeline:
    """Median imputation, scaling and a model: logistic (class-weighted), forest, boosted or mlp."""
    steps = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip"),
        Imputer(inputCols=features, outputCols=[f"_i_{f}" for f in features], strategy="median"),
        VectorAssembler(inputCols=[f"_i_{f}" for f in features], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
    ]
    common = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    models = {
        "logistic": lambda: LogisticRegression(weightCol="_w", probabilityCol="_prob", **common),
        "forest": lambda: RandomForestClassifier(numTrees=100, seed=seed, probabilityCol="_prob", **common),
        "boosted": lambda: GBTClassifier(maxIter=30, seed=seed, **common),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[len(features), 16, classes], seed=seed, **common),
    }
    return Pipeline(stages=[*steps, models[kind]()])


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """`df` with _w, rows over classes over the class's rows."""
    counts = F.broadcast(df.groupBy(label).agg(F.count("*").alias("_n")))  # one row a class
    n, k = df.count(), df.select(label).distinct().count()
    return df.join(counts, label).withColumn("_w", F.lit(float(n)) / (k * F.col("_n"))).drop("_n")


def out_of_fold(df: DataFrame, kind: str, features: list[str], label: str = "label", keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """-> (keys, fold, label, pred_label, confidence): each fold predicted by a model of the others."""
    folds = [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]  # a handful
    classes = sorted(r[0] for r in df.select(label).distinct().collect())  # a handful
    names = F.array(*[F.lit(c) for c in classes])
    parts = []
    for f in folds:
        model = classifier(kind, features, label, len(classes)).fit(weighted(df.where(F.col("fold") != f), label))
        got = model.transform(df.where(F.col("fold") == f).withColumn("_w", F.lit(1.0)))
        sure = F.array_max(vector_to_array("_prob")) if "_prob" in got.columns else F.lit(None).cast("double")
        parts.append(got.select(*keys, "fold", label, F.get(names, F.col("_p").cast("int")).alias("pred_label"), sure.alias("confidence")))
    return reduce(DataFrame.unionByName, parts)


def label_around(days: DataFrame, events: DataFrame, before: int = 5, after: int = 2, out_before: int = 21, out_after: int = 28, subject: str = "subject_id", day: str = "day") -> DataFrame:
    """`days` with label 1 from `before` days before an event to `after` after it, 0 far from every event, NULL between.

    Events spread over their day offsets meet the days by equi-join.
    """
    spread = events.select(subject, F.col(day).alias("_e"), F.explode(F.sequence(F.date_sub(day, out_before), F.date_add(day, out_after))).alias(day))
    near = F.datediff(day, "_e").between(-before, after)
    flags = spread.groupBy(subject, day).agg(F.bool_or(near).alias("_near"))
    label = F.when(F.col("_near"), 1).when(F.col("_near").isNull(), 0)
    return days.join(flags, [subject, day], "left").withColumn("label", label).drop("_near")


def importance(model, features: list[str], top: int = 25) -> list[tuple[str, float]]:
    """The forest's or booster's most important features."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:top]


#: Models fitted in one aggregate a step; terms and degree of a loss polynomial; and the rows of a fold that is fitted by the whole table.
BLOCK, TERMS, DEGREE, LARGE = 64, 1000, 8, 1_000_000


def _step_sums(frames: Iterator[pd.DataFrame], features: list[str], betas: np.ndarray, weights: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (_f, _y, features) -> (fold number, sums): of the weighted loss's gradient and Hessian for every fold's model, over rows of other folds."""
    folds, width = betas.shape
    gradient, hessian = np.zeros((folds, width)), np.zeros((folds, width, width))
    for frame in frames:
        x = np.concatenate([np.ones((len(frame), 1)), frame[features].to_numpy(float)], axis=1)
        y, own = frame["_y"].to_numpy(int), frame["_f"].to_numpy(int)
        for a in range(0, len(x), 4096):
            part = slice(a, a + 4096)
            p = 1 / (1 + np.exp(-np.clip(x[part] @ betas.T, -30, 30)))
            w = weights[:, y[part]].T * (np.arange(folds) != own[part, None])
            gradient += (w * (p - y[part, None])).T @ x[part]
            hessian += np.einsum("nf,ni,nj->fij", w * p * (1 - p), x[part], x[part], optimize=True)
    yield pd.DataFrame({"_f": np.arange(folds), "sums": list(np.concatenate([gradient, hessian.reshape(folds, -1)], axis=1))})


def _damped(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Newton's moves, the largest number of each at most 5."""
    move = np.linalg.solve(hessian + 1e-12 * np.eye(hessian.shape[-1]), gradient[..., None])[..., 0]
    return move * np.minimum(1.0, 5.0 / np.maximum(np.abs(move).max(-1, keepdims=True), 1e-12))


def _class_weights(others: np.ndarray) -> np.ndarray:
    return others.sum(-1, keepdims=True) / (2 * others)


def _fitted(rows: DataFrame, folds: list, others: np.ndarray, features: list[str], strength: float, steps: int, close: float) -> np.ndarray:
    """Coefficients of a few folds' models, fitted at once by Newton steps over the whole table: a step is one aggregate, in which each
    task adds up the gradients and Hessians of all these models over its rows and sends one row a fold. A fold of None leaves no row out."""
    width = len(features) + 1
    betas, weights, ridge = np.zeros((len(folds), width)), _class_weights(others), strength * np.diag([0.0] + [1.0] * len(features))
    table = [(k, f) for k, f in enumerate(folds) if f is not None]
    numbers = rows.sparkSession.createDataFrame(table, T.StructType([T.StructField("_f", T.IntegerType()), T.StructField("_fold", rows.schema["_fold"].dataType)]))
    numbered = rows.join(F.broadcast(numbers), "_fold", "left").select(F.coalesce("_f", F.lit(-1)).alias("_f"), "_y", *features)
    for _ in range(steps):
        now = betas.copy()
        sums = numbered.mapInPandas(lambda it, b=now: _step_sums(it, features, b, weights), "_f int, sums array<double>")
        got = dict(sums.select("_f", F.posexplode("sums").alias("at", "v")).groupBy("_f", "at").agg(F.sum("v").alias("v")).groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).select("_f", "s.v").collect())
        flat = np.array([got[k] for k in range(len(folds))])
        move = _damped(flat[:, :width] + betas @ ridge, flat[:, width:].reshape(-1, width, width) + ridge)
        betas = betas - move
        if np.abs(move).max() < close:
            break
    return betas


class LossPolynomial:
    """The logistic loss of a table's rows near a centre: for each label a polynomial in the scaled distance from it, whose terms are sums over rows.

    `sums` gives them with bounds: how far the gradient may be off at distances up to each of RADII. So a model of all rows but a few needs
    no row but these few, and it is known how exact it is.
    """

    RADII = 0.5 ** np.arange(24)

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        self.centre, self.scale, self.width = centre, scale, len(centre)
        self.degree = max(d for d in range(2, DEGREE + 1) if d == 2 or comb(self.width + d, d) <= TERMS)
        self.powers, self.steps, at = [(0,) * self.width], [], {(0,) * self.width: 0}
        first = 0
        for _ in range(self.degree):  # a term of a degree is one of the degree below, times one variable
            last, made = len(self.powers), []
            for k in range(first, last):
                for j in range(max((i for i in range(self.width) if self.powers[k][i]), default=0), self.width):
                    one = tuple(n + (i == j) for i, n in enumerate(self.powers[k]))
                    at[one] = len(self.powers)
                    self.powers.append(one)
                    made.append((k, j))
            self.steps.append((last, *np.array(made).T))
            first = last
        self.at, self.inverse = at, np.array([1 / np.prod([float(factorial(n)) for n in one]) for one in self.powers])
        slope = np.polynomial.Polynomial([0, 1, -1])  # p (1 - p)
        self.slopes = [np.polynomial.Polynomial([0, 1])]  # the sigmoid's derivatives as polynomials in p
        for _ in range(self.degree):
            self.slopes.append(self.slopes[-1].deriv() * slope)
        t = np.linspace(0, 30, 3001)
        self.steepest = 1.01 * float(np.max(np.abs(self.slopes[-1](1 / (1 + np.exp(t)))) * np.exp(t)))  # |last derivative| <= this * exp(-|t|)

    def terms(self, d: np.ndarray) -> np.ndarray:
        out = np.ones((len(d), len(self.powers)))
        for first, below, by in self.steps:
            out[:, first : first + len(by)] = out[:, below] * d[:, by]
        return out

    def sums(self, frames: Iterator[pd.DataFrame], features: list[str]) -> Iterator[pd.DataFrame]:
        """Rows (_y, features) -> one row a label: its terms' factors and the bounds at RADII."""
        out = np.zeros((2, len(self.powers) + len(self.RADII)))
        for frame in frames:
            x, labels = np.concatenate([np.ones((len(frame), 1)), frame[features].to_numpy(float)], axis=1), frame["_y"].to_numpy(int)
            for a in range(0, len(x), 2048):
                u, y = x[a : a + 2048] / self.scale, labels[a : a + 2048]
                z = u @ (self.centre * self.scale)
                p, terms, of = 1 / (1 + np.exp(-np.clip(z, -700, 700))), self.terms(u), np.stack([y == 0, y == 1]).astype(float)
                for k, (first, _, by) in enumerate(self.steps):
                    part = slice(first, first + len(by))
                    out[:, part] += of * (self.slopes[k](p) - (y if k == 0 else 0)) @ terms[:, part] * self.inverse[part]
                size = np.abs(u).sum(1)[:, None]
                reach = size * self.RADII
                bound = np.log(self.steepest / factorial(self.degree)) + self.degree * np.log(reach) + np.log(size) - np.maximum(np.abs(z)[:, None] - reach, 0)
                out[:, len(self.powers) :] += of @ np.exp(np.minimum(bound, 600))
        yield pd.DataFrame({"_y": [0, 1], "sums": list(out)})

    def derivatives(self, factors: np.ndarray) -> np.ndarray:
        """Factors (labels, terms) -> the matrix that times `terms` of a distance gives both labels' gradients and Hessians."""
        n = self.width
        out = np.zeros((2, n + n * n, len(self.powers)))
        for one, k in self.at.items():
            for i in range(n):
                if one[i]:
                    less = tuple(m - (q == i) for q, m in enumerate(one))
                    out[:, i, self.at[less]] += one[i] * factors[:, k]
                    for j in range(n):
                        if less[j]:
                            out[:, n + i * n + j, self.at[tuple(m - (q == j) for q, m in enumerate(less))]] += one[i] * less[j] * factors[:, k]
        return out

    def without(self, x: np.ndarray, y: np.ndarray, total: np.ndarray, slopes: np.ndarray, bounds: np.ndarray, strength: float, steps: int, close: float) -> tuple[np.ndarray, bool]:
        """(coefficients of the model of all rows but these; whether they are exact to `close`)."""
        n, u = self.width, np.concatenate([np.ones((len(x), 1)), x], axis=1) / self.scale
        w = _class_weights(total - np.bincount(y, minlength=2))
        ridge, d = strength * np.diag([0.0] + [1.0] * (n - 1)) / self.scale**2, np.zeros(n)
        mine, still = w[y], False
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(u @ (self.centre * self.scale + d), -700, 700)))
            both = w @ (slopes @ self.terms(d[None])[0])
            gradient = both[:n] - (mine * (p - y)) @ u + ridge @ (self.centre * self.scale + d)
            hessian = both[n:].reshape(n, n) - (u * (mine * p * (1 - p))[:, None]).T @ u + ridge
            if not np.isfinite(hessian).all() or np.abs(d).max() > 1:
                break
            move = _damped(gradient, hessian)
            d = d - move
            if still := bool(np.abs(move / self.scale).max() < close):
                break
        least = float(np.linalg.eigvalsh(hessian)[0]) if still else 0.0
        near = np.flatnonzero(self.RADII >= np.abs(d).max())
        sure = still and least > 0 and len(near) > 0 and bool((w @ bounds[:, near[-1]]) / least / self.scale.min() <= close)
        return self.centre + d / self.scale, sure


def logistic_by_fold(train: DataFrame, fold: str, features: list[str], label: str, strength: float = 1.0, steps: int = 25, close: float = 1e-9, block: int = BLOCK) -> tuple[DataFrame, list[float]]:
    """Rows with a fold and a label of 0 or 1 -> ((fold, _beta): coefficients, the intercept first, of a class-weighted logistic model of the
    other folds' rows; those of the model of all rows, for folds that have none).

    Up to `block` folds are fitted by passes over the table. Of more, each is fitted by its own rows and the loss polynomial of
    all rows around the model of all rows: the work grows with the rows, not with rows times folds, and the driver holds no fold. Where
    the polynomial's bound does not prove a fold's model exact to `close`, or the fold has over LARGE rows, the fold is
    fitted by passes over the table after all, `block` folds at a time. The penalty is half of `strength` times the squared weights, beside the sum
    of the losses.
    """
    rows = written(train.select(F.col(fold).alias("_fold"), F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]))
    spark, kind = rows.sparkSession, rows.schema["_fold"].dataType
    counts = written(rows.groupBy("_fold").agg(F.count_if(F.col("_y") == 0).alias("_n0"), F.count_if(F.col("_y") == 1).alias("_n1")))
    schema = T.StructType([T.StructField("_fold", kind), T.StructField("_beta", T.ArrayType(T.DoubleType()))])
    folds, *total = counts.agg(F.count("*"), F.sum("_n0"), F.sum("_n1")).first()
    if not folds:
        return spark.createDataFrame([], schema), []
    total = np.array(total, float)
    if alone := counts.where((F.col("_n0") == total[0]) | (F.col("_n1") == total[1])).orderBy("_fold").first():
        raise ValueError(f"the days outside fold {alone[0]} have labels of one kind")
    fit = lambda some, others: _fitted(rows, some, others, features, strength, steps, close)
    by_passes = lambda some: [(r[0], [float(v) for v in b]) for a in range(0, len(some), block) for r, b in zip(some[a : a + block], fit([r[0] for r in some[a : a + block]], total - np.array([r[1:] for r in some[a : a + block]], float)), strict=True)]
    every = fit([None], total[None])[0]
    if folds <= block:
        return spark.createDataFrame(by_passes(counts.orderBy("_fold").collect()), schema), every.tolist()

    squares = rows.agg(*[F.avg(F.col(f) * F.col(f)) for f in features]).first()
    loss = LossPolynomial(every, np.array([1.0, *[float(np.sqrt(v)) or 1.0 for v in squares]]))
    sums = rows.select("_y", *features).mapInPandas(lambda it: loss.sums(it, features), "_y int, sums array<double>")
    sums = np.array([r[0] for r in sums.select("_y", F.posexplode("sums").alias("at", "v")).groupBy("_y", "at").agg(F.sum("v").alias("v")).groupBy("_y").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).orderBy("_y").select("s.v").collect()])  # two rows
    slopes, bounds = loss.derivatives(sums[:, : len(loss.powers)]), sums[:, len(loss.powers) :]

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        beta, sure = loss.without(frame[features].to_numpy(float), frame["_y"].to_numpy(int), total, slopes, bounds, strength, steps, close)
        return pd.DataFrame({"_fold": [key[0]], "_beta": [beta], "_sure": [sure]})

    small = rows.join(counts.where(F.col("_n0") + F.col("_n1") <= LARGE).select("_fold"), "_fold", "left_semi").repartition(min(4096, 8 + folds // 1000), "_fold")  # small rows, much work
    solved = written(small.groupBy("_fold").applyInPandas(one, T.StructType([*schema.fields, T.StructField("_sure", T.BooleanType())])))
    sure = solved.where("_sure").drop("_sure")
    rest = counts.join(sure, "_fold", "left_anti").orderBy("_fold").collect()
    return sure.unionByName(spark.createDataFrame(by_passes(rest), schema)), every.tolist()


def risk_out_of_fold(days: DataFrame, features: list[str], folds: int = 5, label: str = "label", subject: str = "subject_id", day: str = "day", seed: int = 0, how: str = "group") -> DataFrame:
    """Days labelled 1, 0 or NULL -> (subject, day, label, fold, p): the probability of 1 by a class-weighted logistic model of the other subjects.

    Models learn from labelled days and predict unlabelled ones too; a day that is not valid or lacks a feature has no p.
    `how` is that of with_folds: with `loso` every subject is a fold. The days are written once.
    """
    whole = F.coalesce(F.col("valid"), F.lit(False)) & reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])
    df = written(with_folds(days, how, folds, subject, label, seed).withColumn("_whole", whole).select(subject, day, label, F.col("fold").alias("fold"), "_whole", *[F.col(f) for f in features if f not in (subject, day, label, "fold")]))
    betas, every = logistic_by_fold(df.where(F.col("_whole") & F.col(label).isNotNull()), "fold", features, label)
    beta = F.coalesce("_beta", F.array(*[F.lit(v) for v in every])) if every else F.col("_beta")
    own = df.join(betas.withColumnRenamed("_fold", "fold"), "fold", "left").withColumn("_beta", F.when(F.col("fold").isNotNull(), beta))
    z = sum((F.get("_beta", F.lit(k)) * F.col(f) for k, f in enumerate(features, 1)), F.get("_beta", F.lit(0)))
    return own.select(subject, day, label, "fold", F.when(F.col("_whole"), 1 / (1 + F.exp(-z))).alias("p"))


def quantiles_by_rank(df: DataFrame, col: str, wanted: tuple[float, ...]) -> list[float] | None:
    """Quantiles of a column with linear interpolation, None without values: distinct values are counted and ranked within ranges between
    approximate quantiles, of which only those that hold a wanted rank are ordered; no task holds the column."""
    values = written(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n")))
    ranged = values.withColumn("_r", ranges.range_of(F.col("_v"), ranges.bounds(values, "_v")))
    sizes = sorted(tuple(r) for r in ranged.groupBy("_r").agg(F.sum("_n")).collect())  # one row a range
    if not sizes:
        return None
    ends = np.cumsum([n for _, n in sizes])
    at = [q * (int(ends[-1]) - 1) for q in wanted]
    ranks = sorted({int(f(h)) for h in at for f in (np.floor, np.ceil)})
    held = {sizes[int(np.searchsorted(ends, k, "right"))][0] for k in ranks}
    before = dict(zip((r for r, _ in sizes), [0, *ends[:-1].tolist()], strict=True))
    start = F.element_at(F.create_map(*[F.lit(v) for r in sorted(held) for v in (r, int(before[r]))]), F.col("_r"))
    some = ranged.where(F.col("_r").isin(*held)).withColumn("_till", start + F.sum("_n").over(Window.partitionBy("_r").orderBy("_v")))
    hit = F.filter(F.array(*[F.lit(k) for k in ranks]), lambda k: (k >= F.col("_till") - F.col("_n")) & (k < F.col("_till")))
    found = {k: r[0] for r in some.where(F.size(hit) > 0).select("_v", hit).collect() for k in r[1]}  # a row a rank
    return [float(found[lo] if lo == hi else (hi - h) * found[lo] + (h - lo) * found[hi]) for h in at for lo, hi in [(int(np.floor(h)), int(np.ceil(h)))]]


def risk_levels(risks: DataFrame, quantiles: tuple[float, ...] = (0.90, 0.97, 0.99), label: str = "label", p: str = "p") -> DataFrame:
    """Out-of-fold risks -> the rows with level: how many of the cuts p reaches, cuts being quantiles of p over the days far from every event."""
    cuts = quantiles_by_rank(risks.where(F.col(label) == 0), p, quantiles)
    reached = sum((F.col(p) >= c).cast("int") for c in cuts) if cuts else F.lit(None).cast("int")
    return risks.withColumn("level", F.when(F.col(p).isNotNull(), reached))
