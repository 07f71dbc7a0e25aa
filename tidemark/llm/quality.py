"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]): all pairwise interactions in
time linear in the number of words. Inputs are a text's hashed words (log counts, of unit length) and the structure
statistics and length of the same text; labels, language, source and id are no inputs.

The machine is fitted on the driver on a bounded sample of labelled rows (`sample` documents); every document is
scored. Handling of edge cases: null and empty texts are scored by their statistics alone; a very long text is scored
whole; with no usable labels every score is 0.5; repeated rows get equal scores; an empty table gives an empty result;
further columns are dropped by `classify`, whatever their names, and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.features import STATS, rows_of, structure, word_slots
from tidemark.llm.textbytes import Text, chunks
from tidemark.llm.training import held_out, labelled_sample

WIDTH = 1 << 16  # slots of hashed words
FACTORS = 8
SAMPLE = 6_000  # labelled documents that are trained on, at most


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # [WIDTH + stats]
    factors: np.ndarray  # [WIDTH + stats, FACTORS]
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row offsets, indices, values) of a slice's texts."""
        return assembled(word_slots(text, WIDTH), (structure(text) - self.mean) / self.scale)

    def score(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(first, index, value)[0], -30, 30)))

    def margin(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, the factors' sums); every row has its statistics, so none is empty."""
        at = first[:-1]
        v = self.factors[index] * value[:, None]
        sums = np.add.reduceat(v, at)
        squares = np.add.reduceat(v * v, at)
        return self.bias + np.add.reduceat(self.linear[index] * value, at) + 0.5 * (sums**2 - squares).sum(1), sums


def assembled(words: tuple[np.ndarray, np.ndarray, np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' log counts scaled to unit length, with the row's statistics after them."""
    first, slots, counts = words
    n, k = stats.shape
    value = np.log1p(counts).astype(np.float32)
    rows = rows_of(first)
    norm = np.sqrt(np.bincount(rows, value * value, n)) + 1e-9
    value /= norm[rows]
    out_first = first + k * np.arange(n + 1)
    index, values = np.empty(out_first[-1], np.int32), np.empty(out_first[-1], np.float32)
    at = np.arange(len(slots)) + k * rows
    index[at], values[at] = slots, value
    tail = (out_first[1:, None] - k + np.arange(k)).ravel()
    index[tail] = np.tile(WIDTH + np.arange(k), n)
    values[tail] = np.clip(stats, -4, 4).ravel() * 0.5
    return out_first, index, values


def fit(first: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray, mean: np.ndarray, scale: np.ndarray, epochs: int = 12, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss, in batches of 128 documents."""
    rng = np.random.default_rng(seed)
    size = WIDTH + len(mean)
    p = min(max(float(labels.mean()), 0.01), 0.99)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), mean, scale)
    params = np.concatenate([m.linear[:, None], m.factors], axis=1)
    moment, second = np.zeros_like(params), np.zeros_like(params)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), 128):
            chosen = order[a : a + 128]
            parts = np.concatenate([np.arange(first[r], first[r + 1]) for r in chosen])
            lengths = np.diff(first)[chosen]
            at = np.concatenate([[0], np.cumsum(lengths)])
            i, x = index[parts], value[parts]
            z, sums = m.margin(at, i, x)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]
            row = np.repeat(np.arange(len(chosen)), lengths)
            gx = (g[row] * x / len(chosen)).astype(np.float32)
            used, place = np.unique(i, return_inverse=True)
            grad = np.empty((len(used), FACTORS + 1), np.float32)
            grad[:, 0] = np.bincount(place, gx, len(used))
            inner = sums[row] - m.factors[i] * x[:, None]
            for f in range(FACTORS):
                grad[:, f + 1] = np.bincount(place, gx * inner[:, f], len(used))
            grad += decay * params[used]
            step += 1
            moment[used] = 0.9 * moment[used] + 0.1 * grad
            second[used] = 0.99 * second[used] + 0.01 * grad**2
            params[used] -= rate * (moment[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-6)
            m.linear, m.factors = params[:, 0], params[:, 1:]
            m.bias -= rate * float(g.mean())
    return Machine(m.bias, np.ascontiguousarray(params[:, 0]), np.ascontiguousarray(params[:, 1:]), mean, scale)


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, label) -> (label, slots, counts, stats) as binaries."""
    for batch in batches:
        for at, text in chunks(batch.column(1)):
            first, slots, counts = word_slots(text, WIDTH)
            stats = structure(text)
            rows = range(len(text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(text)), batch.column(2).slice(at, len(text)),
                    pa.array([slots[first[r] : first[r + 1]].tobytes() for r in rows], pa.binary()),
                    pa.array([counts[first[r] : first[r + 1]].astype(np.int32).tobytes() for r in rows], pa.binary()),
                    pa.array([stats[r].tobytes() for r in rows], pa.binary()),
                ],
                names=["_id", "_label", "_slots", "_counts", "_stats"],
            )


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine | None:
    """The fitted machine; None without a usable label. Collects at most `sample` documents' hashed words."""
    chosen = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    got = chosen.mapInArrow(_inputs, "_id bigint, _label int, _slots binary, _counts binary, _stats binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("_id")
    slots = [np.frombuffer(x, np.int32) for x in got["_slots"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in got["_counts"].to_pylist()])
    stats = np.stack([np.frombuffer(x, np.float32) for x in got["_stats"].to_pylist()])
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    first = np.concatenate([[0], np.cumsum([len(s) for s in slots])])
    inputs = assembled((first, np.concatenate(slots), counts), (stats - mean) / scale)
    return fit(*inputs, (got["_label"].to_numpy() > 0).astype(np.float32), mean, scale)


def score_quality(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, score), one row per input row: the probability of label 1. A row-by-row job without a shuffle."""
    if machine is None:
        return docs.select(id_col, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, text in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(text)), pa.array(m.score(*m.inputs(text)).astype(np.float64))], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """-> (id_col, held_out, score, predicted)."""
    scored = score_quality(docs, train(docs, labels, "quality", id_col, text_col, sample), id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score below 0.5; all their columns stay."""
    if machine is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, text in chunks(batch.column(at_text)):
                yield batch.slice(at, len(text)).filter(pa.array(m.score(*m.inputs(text)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


assert len(STATS) == 14
