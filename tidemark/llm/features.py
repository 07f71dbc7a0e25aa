"""Hashed text features for the trained classifiers, computed slice by slice inside tasks."""

from __future__ import annotations

import numpy as np

from tidemark.llm.textbytes import LOWERED, Text

#: Structure statistics of a text, in order.
STATS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "blanks", "newlines", "non_ascii", "stops",
    "distinct_words", "top_word", "symbol_after_word", "capitalised",
)


def counted(rows: np.ndarray, slots: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, slots, counts) of the distinct slots of each of n rows."""
    key, counts = np.unique(rows.astype(np.int64) * width + slots, return_counts=True)
    row = key // width
    return np.searchsorted(row, np.arange(n + 1)), (key % width).astype(np.int32), counts


def rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def structure(text: Text) -> np.ndarray:
    """float32[rows, len(STATS)]: shares of kinds of bytes and words; 0 for an empty text."""
    raw, offsets = text.raw, text.offsets
    starts, ends, first = text.words()
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    n_words = np.diff(first)
    words = np.maximum(n_words, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    def of_words(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (sums[first[1:]] - sums[first[:-1]]) / words

    upper = LOWERED[raw] != raw
    digit = (raw >= 48) & (raw < 58)
    blank, newline, wide = raw == 32, raw == 10, raw >= 128
    letter = upper | ((raw >= 97) & (raw < 123)) | digit | wide
    symbol = ~(letter | blank | newline | (raw == 46) | (raw == 44))
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    per_row, _, counts = counted(rows_of(first), (text.hashes(starts, ends) & np.uint64((1 << 31) - 1)).astype(np.int64), len(text), 1 << 31)
    top = np.zeros(len(text))
    full = np.flatnonzero(np.diff(per_row))
    if len(full):
        top[full] = np.maximum.reduceat(counts, per_row[:-1][full])
    tail = np.zeros(len(ends), bool)
    inside = ends < len(raw)
    tail[inside] = symbol[ends[inside]]
    out = np.stack(
        [
            np.log1p(np.diff(offsets)), np.log1p(n_words), of_words(ends - starts), share(upper), share(digit), share(symbol), share(blank), share(newline), share(wide), share(stop),
            np.diff(per_row) / words, top / words, of_words(tail), of_words(upper[starts] if len(starts) else np.zeros(0, bool)),
        ],
        axis=1,
    )
    return out.astype(np.float32)


def word_slots(text: Text, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, slots, counts) of hashed words."""
    starts, ends, first = text.words()
    return counted(rows_of(first), (text.hashes(starts, ends) % np.uint64(width)).astype(np.int64), len(text), width)


def word_and_prefix_slots(text: Text, width: int, prefixes: tuple[int, ...] = (4, 6, 8)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of hashed words and of their prefixes of so many bytes, which meet inflected and compound words."""
    starts, ends, first = text.words()
    rows = rows_of(first)
    all_rows, all_slots = [rows], [text.hashes(starts, ends) % np.uint64(width)]
    for k, n in enumerate(prefixes, 1):
        long = np.flatnonzero(ends - starts > n)
        h = text.hashes(starts[long], starts[long] + n) + np.uint64(0x632BE59BD9B4E019 * k % (1 << 64))
        all_rows.append(rows[long])
        all_slots.append(h % np.uint64(width))
    return counted(np.concatenate(all_rows), np.concatenate(all_slots).astype(np.int64), len(text), width)
