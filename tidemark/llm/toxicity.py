"""Toxicity: a classifier chain of linear models.

Categories are predicted one after another; each model sees the hashed words and word prefixes of the text and the
probabilities of the categories before it. While training, these probabilities are out-of-fold predictions, so that
a later model does not trust an earlier one's fit to its own training rows. The categories of the chain are learned: the
kinds of toxic documents are clusters of the labelled ones by their telling words (spherical k-means with seeded starts;
a toxic row without a telling word is of no kind), and last comes `toxic`, the given label.

Models are fitted on the driver on a bounded sample of labelled rows (`sample` documents) over the features with the
largest chi-square in it; every document is scored. Handling of edge cases: null and empty texts get the models'
intercepts; a very long text is scored whole; with no usable labels every score is 0; repeated rows get equal scores; an
empty table gives an empty result; further columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.features import rows_of, word_and_prefix_slots
from tidemark.llm.textbytes import chunks
from tidemark.llm.training import held_out, labelled_sample

WIDTH = 1 << 20
SAMPLE = 12_000  # labelled documents that are trained on, at most
FEATURES = 1_024  # of the models, at most
FOLDS = 4

KINDS = ("kind_1", "kind_2", "kind_3")  # learned categories before the last
CHAIN = (*KINDS, "toxic")


@dataclass
class Chain:
    columns: np.ndarray  # slot -> feature number or -1
    weights: list[np.ndarray]  # of each category: features, earlier categories, intercept

    def inputs(self, first: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """float32[rows, features]: presence of each feature."""
        n = int(self.columns.max(initial=-1)) + 1
        out = np.zeros((len(first) - 1, n), np.float32)
        column = self.columns[slots]
        known = column >= 0
        out[rows_of(first)[known], column[known]] = 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities [rows, categories], each given the ones before."""
        seen: list[np.ndarray] = []
        for w in self.weights:
            seen.append(predict(w, x, seen))
        return np.stack(seen, axis=1)


def predict(w: np.ndarray, x: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
    z = x @ w[: x.shape[1]] + w[-1]
    for k, p in enumerate(seen):
        z = z + w[x.shape[1] + k] * p
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, seen: list[np.ndarray], y: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam on all rows, its rate falling to 0; in float64, so that machines agree."""
    full = np.concatenate([x, *[s[:, None] for s in seen], np.ones((len(x), 1))], axis=1, dtype=np.float64)
    y = y.astype(np.float64)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w = np.zeros(full.shape[1])
    w[-1] = np.log(p / (1 - p))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = full.T @ (1 / (1 + np.exp(-np.clip(full @ w, -30, 30))) - y) / len(y)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def telling(first: np.ndarray, slots: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slots of at least four documents, commoner in toxic ones, with the largest chi-square: FEATURES at most, sorted."""
    n, rows = len(first) - 1, rows_of(first)
    all_n = np.bincount(slots, minlength=WIDTH).astype(np.float64)
    hit_n = np.bincount(slots, toxic[rows], WIDTH)
    p = min(max(float(toxic.mean()), 1e-6), 1 - 1e-6)
    chi = (hit_n - all_n * p) ** 2 / np.maximum(all_n * p * (1 - p) * (1 - all_n / max(n, 1) + 1e-9), 1e-9)
    chi[(hit_n < all_n * p) | (all_n < 4)] = 0
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] > 15])


def clusters(x: np.ndarray, k: int, rounds: int = 20, restarts: int = 8) -> np.ndarray:
    """Spherical k-means: the cluster of each row, -1 for rows without a feature.

    Each of the seeded restarts starts from rows, drawn one after another with a chance that grows with their distance from
    those drawn before; the result in which rows lie closest to their centres stays.
    """
    out = np.full(len(x), -1)
    length = np.linalg.norm(x.astype(np.float64), axis=1)
    rows = np.flatnonzero(length > 0)
    if not len(rows):
        return out
    unit = x[rows] / length[rows, None]
    best = -1.0
    for seed in range(restarts):
        draw = np.random.default_rng(seed)
        centre = unit[[draw.integers(len(rows))]]
        while len(centre) < k:
            far = np.maximum(1 - (unit @ centre.T).max(1), 0) ** 2 + 1e-12
            centre = np.concatenate([centre, unit[[np.searchsorted(np.cumsum(far), draw.random() * far.sum())]]])
        for _ in range(rounds):
            own = np.argmax(unit @ centre.T, axis=1)
            for j in range(k):
                if (own == j).any():
                    mean = unit[own == j].mean(0)
                    centre[j] = mean / np.linalg.norm(mean)
        near = unit @ centre.T
        if near.max(1).sum() > best + 1e-9:
            best, out[rows] = near.max(1).sum(), np.argmax(near, axis=1)
    return out


def fit_chain(first: np.ndarray, slots: np.ndarray, toxic: np.ndarray) -> Chain:
    """Select features, cluster the toxic rows into kinds, then fit the categories in turn."""
    n, best = len(first) - 1, telling(first, slots, toxic)
    columns = np.full(WIDTH, -1, np.int32)
    columns[best] = np.arange(len(best))
    chain = Chain(columns, [])
    x = chain.inputs(first, slots)
    kind = np.full(n, -1)
    if toxic.any() and len(best):
        kind[toxic > 0] = clusters(x[toxic > 0], len(KINDS))
    targets = [(kind == k).astype(np.float32) for k in range(len(KINDS))] + [toxic]
    fold = np.arange(n) % FOLDS
    seen: list[np.ndarray] = []
    for y in targets:
        out = np.zeros(n)
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            w = fit_linear(x[train], [s[train] for s in seen], y[train])
            out[test] = predict(w, x[test], [s[test] for s in seen])
        chain.weights.append(fit_linear(x, seen, y))
        seen.append(out)
    return chain


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, label) -> (id, label, slots as binary)."""
    for batch in batches:
        for at, text in chunks(batch.column(1)):
            first, slots, _ = word_and_prefix_slots(text, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(text)), batch.column(2).slice(at, len(text)), pa.array([slots[first[r] : first[r + 1]].tobytes() for r in range(len(text))], pa.binary())], names=["_id", "_label", "_slots"]
            )


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain | None:
    """The fitted chain; None without a usable label. Collects at most `sample` documents' hashed words."""
    chosen = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    got = chosen.mapInArrow(_inputs, "_id bigint, _label int, _slots binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("_id")
    slots = [np.frombuffer(x, np.int32) for x in got["_slots"].to_pylist()]
    toxic = (got["_label"].to_numpy() > 0).astype(np.float32)
    return fit_chain(np.concatenate([[0], np.cumsum([len(s) for s in slots])]), np.concatenate(slots), toxic)


def score_toxicity(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, one probability for each category of CHAIN), one row per input row. No shuffle."""
    if chain is None:
        return docs.select(id_col, *[F.lit(0.0).alias(c) for c in CHAIN])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at, text in chunks(batch.column(1)):
                first, slots, _ = word_and_prefix_slots(text, WIDTH)
                p = c.score(c.inputs(first, slots)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(text)), *[pa.array(p[:, k]) for k in range(len(CHAIN))]], names=["_id", *CHAIN])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} double" for c in CHAIN)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {fields}").withColumnRenamed("_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """-> (id_col, held_out, score, predicted, categories): score of `toxic`; categories above 0.5, comma-joined."""
    p = score_toxicity(docs, train(docs, labels, "toxic", id_col, text_col, sample), id_col, text_col)
    named = F.array_join(F.filter(F.array(*[F.when(F.col(c) >= 0.5, F.lit(c)) for c in KINDS]), lambda x: x.isNotNull()), ",")
    return p.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("toxic").alias("score"), (F.col("toxic") >= 0.5).cast("int").alias("predicted"), named.alias("categories"))
