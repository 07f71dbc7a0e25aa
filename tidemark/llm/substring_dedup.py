"""Substring dedup by sliding sentence spans: hash runs of consecutive sentences, join globally, drop covered sentences.

A sentence ends after a newline or after `.`, `!` or `?` and a blank; stretches without a word belong to the
sentence before (at a text's start, to the one after). From every sentence the shortest run forward, and to
every sentence the shortest run backward, of at least two sentences and `min_words` words is hashed, by its
words with ASCII case and punctuation ignored; a sentence of twice as many words is also a run alone. Any repeated
passage of twice `min_words` words in whole sentences is covered by such runs to its ends. Every run of FEW sentences is
hashed too, from FEW_WORDS words on, so that short passages which stand in many documents are met.

The first occurrence of a run is the one in the document with the smallest id (of equal ids, the row written
first), and there the earliest; every sentence covered by another occurrence goes. All occurrences are joined, however many documents share a run.

Handling of edge cases: null and wordless texts have no sentences and stay as they are; every row is a document of
its own under a written row number, also rows that share an id; null ids come before all others; a very long text is
cut whole, alone; an empty table gives an empty result; further columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash
from tidemark.llm.textbytes import Text, chunks, mix

MIN_WORDS = 25
FEW, FEW_WORDS = 3, 12  # sentences and words of the short runs


def sentences(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, rows' first sentences (rows + 1), words' first numbers (sentences + 1), word hashes)."""
    raw = text.raw
    blank = raw == 32
    after_stop = np.zeros(len(raw), bool)
    after_stop[1:] = (raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)
    cut = np.flatnonzero((raw == 10) | (blank & after_stop)) + 1
    starts = np.unique(np.concatenate([cut[cut < len(raw)], text.offsets[:-1][np.diff(text.offsets) > 0]]))
    ws, we, _ = text.words()
    h = text.hashes(ws, we)
    first = np.searchsorted(ws, starts)
    worded = np.diff(np.append(first, len(ws))) > 0
    starts, first = starts[worded], np.append(first[worded], len(ws))
    return starts, np.searchsorted(starts, text.offsets), first, h


def runs(text: Text, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, first sentence, last sentence, hash) of each run, sentences numbered within the row; and their row offsets."""
    starts, rows_first, words_first, h = sentences(text)
    n = len(starts)
    counts = np.diff(rows_first)
    row = np.repeat(np.arange(len(text)), counts)
    begin, end = rows_first[:-1][row], rows_first[1:][row]
    i = np.arange(n)
    c_start, c_end = words_first[:-1], words_first[1:]
    forward = np.maximum(np.searchsorted(c_end, c_start + min_words), i + 1)
    backward = np.minimum(np.searchsorted(c_start, c_end - min_words, "right") - 1, i - 1)
    f_ok, b_ok, alone = forward < end, backward >= begin, c_end - c_start >= 2 * min_words
    few = i[i + FEW - 1 < end]
    few = few[words_first[few + FEW] - words_first[few] >= FEW_WORDS]
    lo = np.concatenate([i[f_ok], backward[b_ok], i[alone], few])
    hi = np.concatenate([forward[f_ok], i[b_ok], i[alone], few + FEW - 1])
    pair = np.unique(lo * np.int64(n + 1) + hi)
    lo, hi = pair // (n + 1), pair % (n + 1)
    # polynomial over the words of each run, from one running sum
    power, inverse = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    a, b = words_first[lo], words_first[hi + 1]
    value = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return row[lo], lo - begin[lo], hi - begin[lo], value, starts, rows_first


_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        base = 0xD6E8FEB86659FD93
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            each = np.full(max(n, 1 << 20), b, np.uint64)
            each[0] = 1
            both.append(np.cumprod(each))
        _cache[:] = both
    return _cache[0], _cache[1]


def _first_in_row(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each run is the earliest of its row with its hash (runs come in order within a row)."""
    order = np.lexsort((np.arange(len(row)), value, row))
    r, v = row[order], value[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    out = np.zeros(len(r), bool)
    out[order] = fresh
    return out


def _spans(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(id, row, text) -> (hash, id, row, lo, hi) of the runs that are their row's earliest of that hash."""
    for batch in batches:
        for at, text in chunks(batch.column(2)):
            row, lo, hi, value, _, _ = runs(text, min_words)
            keep = _first_in_row(row, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[keep].view(np.int64)), *[batch.column(k).take(pa.array(at + row[keep])) for k in (0, 1)], pa.array(lo[keep].astype(np.int32)), pa.array(hi[keep].astype(np.int32))], names=["_hash", "_id", "_row", "_lo", "_hi"]
            )


def _cut(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(id, text, spans as array of lo, hi, first flags) -> (id, n_sentences, n_repeated, n_removed, text)."""
    for batch in batches:
        spans = batch.column(2)
        for at, text in chunks(batch.column(1)):
            row, lo, hi, value, starts, rows_first = runs(text, min_words)
            n = len(starts)
            again = ~_first_in_row(row, value)
            listed = spans.slice(at, len(text))
            counts = np.array([len(x) if x.is_valid else 0 for x in listed], np.int64) // 3
            flat = np.array(listed.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, 3)
            owner = np.repeat(np.arange(len(text)), counts)
            base = rows_first[:-1]
            out_lo = np.concatenate([base[row[again]] + lo[again], base[owner] + flat[:, 0]])
            out_hi = np.concatenate([base[row[again]] + hi[again], base[owner] + flat[:, 1]])
            drop = np.concatenate([np.ones(int(again.sum()), bool), flat[:, 2] == 0])
            gone, repeated = _covered(n, out_lo[drop], out_hi[drop]), _covered(n, out_lo, out_hi)
            stops = np.append(starts[1:], len(text.raw))
            last = rows_first[1:][np.diff(rows_first) > 0] - 1
            stops[last] = text.offsets[1:][np.diff(rows_first) > 0]
            begins = starts.copy()
            firsts = rows_first[:-1][np.diff(rows_first) > 0]
            begins[firsts] = text.offsets[:-1][np.diff(rows_first) > 0]
            texts, per_row = [], batch.column(1).slice(at, len(text))
            removed = _per_row(gone, rows_first)
            for r in range(len(text)):
                if not removed[r]:
                    texts.append(per_row[r].as_py())
                else:
                    own = range(int(rows_first[r]), int(rows_first[r + 1]))
                    texts.append(b"".join(text.raw[begins[s] : stops[s]].tobytes() for s in own if not gone[s]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(text)), pa.array(np.diff(rows_first).astype(np.int64)), pa.array(_per_row(repeated, rows_first)), pa.array(removed), pa.array(texts, pa.string())
                ],
                names=["_id", "n_sentences", "n_repeated", "n_removed", "text"],
            )


def _covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi + 1, -1)
    return np.cumsum(steps)[:n] > 0


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """-> (id_col, n_sentences, n_repeated, n_removed, text), one row per input row.

    n_repeated: sentences within some repeated run, first occurrences included; n_removed: those that went; text: the rest.
    """
    rows = stash(docs.select(F.col(id_col).cast("bigint").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text")))
    spans = stash(rows.mapInArrow(lambda b: _spans(b, min_words), "_hash bigint, _id bigint, _row bigint, _lo int, _hi int"))
    # a row has each hash once; the least of structs has null ids first. Written, both sides of the join come from plain
    # exchanges, whose skewed partitions Spark splits: the occurrences of one very common passage are not one task's work
    repeated = spans.groupBy("_hash").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_hash", "_first")
    marked = spans.join(stash(repeated), "_hash").select("_row", F.array("_lo", "_hi", (F.col("_row") == F.col("_first")).cast("int")).alias("_span"))
    per_row = stash(marked.groupBy("_row").agg(F.flatten(F.collect_set("_span")).alias("_spans")))
    held = rows.join(per_row, "_row", "left").select("_id", "_text", "_spans")
    out = held.mapInArrow(lambda b: _cut(b, min_words), "_id bigint, n_sentences bigint, n_repeated bigint, n_removed bigint, text string")
    return out.withColumnRenamed("_id", id_col)
