"""Fill-in-middle: cut each text into three pieces at unit boundaries and move the middle to the end.

A text is decoded to a UTF-32 array of code points. A boundary lies wherever the classes of two neighbours differ in the
way the unit asks for (UNITS); `flatnonzero` lists them, two hashed ranks choose two of them, and the pieces between are
sliced out and encoded again. Ranks and form come from one SHA-256 of a seed and the document's id, so a text is cut alike
on every run and every executor, whatever its partition.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text itself: an empty
text, a text that holds a sentinel, and the share of documents that `percent` leaves out. As no text that is cut holds a
sentinel, `restored` gives every text back from output and form alone.

Handling of edge cases: a null text counts as empty; a null id hashes as an empty id; a very long text is cut alone and
whole, so memory is bounded by one text and one Arrow batch; rows that share id and text get equal outputs; an empty table
gives an empty result; all columns of the input stay, but for those named as an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textbytes import parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUTS = ("units", "form", "prefix_chars", "middle_chars", "output", "restored")
SLICE = 4 << 20  # bytes of text that become Python strings at once

OTHER, BLANK, NEWLINE = 0, 1, 2
#: unit -> whether a boundary lies between a code point of the row's class and one of the column's.
UNITS = {
    "line": np.array([[0, 0, 0], [0, 0, 0], [1, 1, 1]], bool),  # after every newline
    "word": np.array([[0, 1, 1], [1, 0, 1], [1, 1, 1]], bool),  # where blanks begin or end, and at newlines
    "char": np.ones((3, 3), bool),
}


@dataclass(frozen=True)
class Cut:
    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point; blank are ASCII space and tab."""
    return np.where(points == 10, NEWLINE, np.where((points == 32) | (points == 9), BLANK, OTHER)).astype(np.int8)


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Starts of the units and, last, the text's length: units + 1 numbers, or just [0] for an empty text."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points)
    inner = np.flatnonzero(UNITS[unit][kind[:-1], kind[1:]]) + 1
    return np.concatenate([[0], inner, [len(points)]])


def ranks(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4))


def cut(text: str, doc_id: int | None, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50) -> Cut:
    points = code_points(text)
    at = boundaries(points, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = ranks(seed, doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
        return Cut(n, "plain", None, None, text)
    a, b = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le", "surrogatepass") for p in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < spm_percent:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str, form: str) -> str:
    """The text that `cut` made `output` of."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    first, _, rest = output[len(PREFIX) :].partition(second)
    other, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (first, other) if form == "psm" else (other, first)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """`docs` with units (bigint), form, prefix_chars, middle_chars (bigint, null if plain), output and restored (the text
    rebuilt from output and form). `percent` of the documents are cut, `spm_percent` of these in the suffix-first form.
    A row-by-row job without a shuffle.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    docs = docs.drop(*OUTPUTS)
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in parts(batch, at, SLICE):
                cuts = [cut(t or "", i, unit, seed, percent, spm_percent) for t, i in zip(own.column(at).to_pylist(), own.column(key).to_pylist(), strict=True)]
                made = [
                    pa.array([c.units for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()), pa.array([c.prefix_chars for c in cuts], pa.int64()),
                    pa.array([c.middle_chars for c in cuts], pa.int64()), pa.array([c.output for c in cuts], pa.string()), pa.array([restored(c.output, c.form) for c in cuts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*batch.schema.names, *OUTPUTS])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, units bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string")
