"""Words, sentences and their hashes over the bytes of Arrow string columns, a few MB at a time.

Words are runs of ASCII letters and digits and of any bytes above 127, ASCII lower-cased. A span's hash is a
polynomial over its bytes, read off one running sum, so hashing costs the same whatever the spans are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19  # bytes of text handled at once; a longer text is handled alone

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    WORD_BYTE[_lo:_hi] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            each = np.full(size, b, np.uint64)
            each[0] = 1
            _powers[k] = np.cumprod(each)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Text:
    """A slice of a string column: its rows' bytes end to end. A null row counts as empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets, self.raw = offsets - offsets[0], raw
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> np.ndarray:
        return LOWERED[self.raw]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (byte offsets) of the words, and how many begin before each row (rows + 1 numbers)."""
        inside = WORD_BYTE[self.raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        ends[last] = inside[last]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lower-cased byte spans."""
        up, down = _grown(len(self.raw) + 1)
        if self._sums is None:
            sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum((self.lowered().astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=sums[1:])
            self._sums = sums
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, Text]]:
    """(first row, Text) slices of about `most` bytes that cover the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    whole = Text(column).offsets
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(whole, whole[row] + most, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, Text(column.slice(row, stop - row))
        row = stop


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of the text column each; a longer text stands alone."""
    row, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(row, k - row)
            row, held = k, 0
        held += n
    if row < batch.num_rows:
        yield batch.slice(row)


def shingles(text: Text, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's runs of n words, end to end, and their offsets (rows + 1).

    A row of fewer words (but one at least) has one shingle of all its words.
    """
    starts, ends, first = text.words()
    h = text.hashes(starts, ends)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(text)), counts)
    out = h.copy()
    own = np.repeat(first[1:], counts) - np.arange(len(h))  # words from here to the row's end
    for k in range(1, n):
        more = own > k
        at = np.flatnonzero(more)
        out[at] = mix(out[at] * np.uint64(0x100000001B3) + h[at + k])
    full = (own >= n) | ((counts[rows] < n) & (own == counts[rows])) if len(h) else np.zeros(0, bool)
    out, rows = out[full], rows[full]
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    out, rows = out[fresh], rows[fresh]
    return out, np.searchsorted(rows, np.arange(len(text) + 1))
