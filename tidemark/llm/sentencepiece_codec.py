"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Texts are cut at blanks; each word, marked with U+2581 in the blank's place, is segmented on its own into the pieces of
the vocabulary with the largest sum of scores. A task sorts the distinct marked words it has not met lately: their
sorted list is a trie read depth-first, so the forward scores of a common prefix are computed once and kept
on a stack while its words follow. Characters without a piece become byte pieces. Decoding joins the pieces.

Handling of edge cases: a null text gives null; an empty text gives no ids and decodes to an empty text; blanks at
either end, repeated blanks and U+2581 itself (as bytes) survive a round trip; ties go to the shorter last piece;
repeated rows each keep their row; an empty table gives an empty result; further columns stay, but for those named as an
output. A very long text is handled alone, a long word is segmented anew wherever it stands, so memory is bounded by
one text, one Arrow batch and KEPT, whatever the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidemark.llm.textbytes import chunks

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEPT = 16 << 20  # bytes of words and ids that a worker remembers
LONGEST_KEPT = 64  # characters of a word that is remembered
OUTPUTS = ("ids", "n_ids", "round_trip", "decoded_sha256")
GATHER = 2 << 20  # bytes of text whose words are sorted together


class Pieces:
    """A vocabulary's pieces, scores and ids, and the segmenter over them."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.text: list[bytes] = []
        for k in range(sp.get_piece_size()):
            p = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(p[3:5], 16)] = k
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.text.append(b"")
            else:
                self.text.append(p.replace(MARK, " ").encode())
                if MARK not in p[1:]:  # words hold the mark in front only
                    self.id[p], self.score[p] = k, sp.get_score(k)
        # score of every piece and, as minus infinity, of every end of one: where a stretch is none, no longer one is
        self.tails = {p[k:]: -inf for p in self.score for k in range(1, len(p))} | self.score
        self.unknown = min(self.score.values()) - 10.0
        self.known: dict[str, tuple[int, ...]] = {}
        self.kept = 0  # bytes of `known`, about

    def segmented(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words (without mark; U+2581 within them counts as unknown)."""
        score, tail, unknown = self.score.get, self.tails.get, self.unknown
        out: dict[str, tuple[int, ...]] = {}
        best, back = [0.0], [0]  # of each prefix length: forward score, start of the last piece
        before = ""
        for word in sorted(words):
            marked = MARK + word.replace(MARK, "\0") if MARK in word else MARK + word
            n = len(marked)
            shared = _common(before, marked)
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, n + 1):
                start = end - 1
                top = best[start] + score(marked[start], unknown)
                for a in range(end - 2, -1, -1):
                    s = tail(marked[a:end])
                    if s is None:
                        break
                    s += best[a]
                    if s > top:
                        top, start = s, a
                best.append(top)
                back.append(start)
            before = marked
            ids: list[int] = []
            end = n
            while end:
                a = back[end]
                k = self.id.get(marked[a:end])
                if k is None:
                    c = marked[a:end].replace("\0", MARK) if MARK in word else marked[a:end]
                    ids.extend(self.byte[x] for x in reversed(c.encode("utf-8", "surrogatepass")))
                else:
                    ids.append(k)
                end = a
            ids.reverse()
            out[word] = tuple(ids)
        return out

    def learn(self, words: set[str], needed: Iterable[str] = ()) -> None:
        """Segment words and remember them; if there is no room, what was remembered before goes, but for what is needed."""
        found = self.segmented(words)
        size = sum(map(_size, found.items()))
        if self.kept + size > KEPT:
            self.known = {w: self.known[w] for w in needed}
            self.kept = sum(map(_size, self.known.items()))
        self.known.update(found)
        self.kept += size

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        split = [t.split(" ") if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        fresh = words.difference(self.known)
        self.learn(fresh, words.difference(fresh))
        get = self.known.__getitem__
        ids = [None if t is None else list(chain.from_iterable(map(get, ws))) for t, ws in zip(texts, split, strict=True)]
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                self.kept -= _size((w, self.known.pop(w)))
        if self.kept > KEPT:
            self.known, self.kept = {}, 0
        return ids

    def decode(self, ids) -> str:
        text = self.text
        return b"".join([text[k] for k in ids])[1:].decode("utf-8", "replace")


def _size(item: tuple[str, tuple[int, ...]]) -> int:
    """Bytes of a word, its ids and their place in a table, about."""
    return 250 + 2 * len(item[0]) + 8 * len(item[1])


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(batches: Iterator[pa.RecordBatch], column: int, path: str) -> Iterator[pa.RecordBatch]:
    p = pieces(path)
    for batch in batches:
        for a, text in chunks(batch.column(column), GATHER):
            own = [c.slice(a, len(text)) for c in batch.columns]
            texts = own[column].to_pylist()
            ids = p.encode_all(texts)
            decoded = [None if x is None else p.decode(x) for x in ids]
            same = [None if t is None else t == d for t, d in zip(texts, decoded, strict=True)]
            sha = [None if d is None else hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            lengths = np.array([0 if x is None else len(x) for x in ids], np.int64)
            nulls = np.array([x is None for x in ids], bool)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(x for x in ids if x), np.int32, int(lengths.sum()))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(nulls))
            yield pa.RecordBatch.from_arrays([*own, lists, pa.array(lengths, mask=nulls), pa.array(same, pa.bool_()), pa.array(sha, pa.string())], names=[*batch.schema.names, *OUTPUTS])


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """`docs` with ids (array<int>), n_ids, round_trip (the ids decode to the very text) and decoded_sha256; null for a null text.

    The model is a file that the driver reads and sends to the executors. A row-by-row job without a shuffle.
    """
    docs = docs.drop(*OUTPUTS)
    file = _sent(docs, model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _encode(b, at, SparkFiles.get(file)), f"{fields}, ids array<int>, n_ids bigint, round_trip boolean, decoded_sha256 string")


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """`encoded` with its ids' text as `out_col`; null ids give null."""
    docs = encoded.drop(out_col) if out_col in encoded.columns else encoded
    file = _sent(docs, model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(ids_col)

    def run(batches):
        p = pieces(SparkFiles.get(file))
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                own = batch.slice(a, 100)
                texts = [None if x is None else p.decode(x.values.to_numpy().tolist()) for x in own.column(at)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_decoded"])

    return docs.mapInArrow(run, f"{fields}, _decoded string").withColumnRenamed("_decoded", out_col)


def _sent(df: DataFrame, model: str) -> str:
    df.sparkSession.sparkContext.addFile(model)
    return model.rsplit("/", 1)[-1]
