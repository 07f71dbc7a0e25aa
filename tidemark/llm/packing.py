"""Packing along a space-filling curve: documents that resemble each other share training sequences.

Each document is tokenised and ends with an end id. Its hashed vector (ids hashed into buckets, counts damped by the
square root, unit length) is projected to four dimensions by fixed random directions, and its place on a Hilbert curve
through them is its key. Rows are range-sorted by the key and each range is laid end to end and cut every
`length` ids, so neighbours on the curve stand in the same sequences. What is left at the end of a range is cut into
sequences whose lengths are powers of two, which need no padding: no id is padding anywhere. A range adds at most
log2(length) such short sequences, and only ranges are counted, not documents.

Tokenising: the vocabulary drops white space and case and no token crosses white space, a run of letters or a run of marks
(contractions apart), so texts are cut at blanks and newlines, and a worker remembers the ids of what lies between. What it has
not met is cut further into ASCII marks around a run of letters; runs of letters are tokenised in long lines, and every id
that ends a word closes a run. Anything else is tokenised alone. A text that names a special token is tokenised whole, as the vocabulary's library would.

Handling of edge cases: a null or blank text is the end id alone; repeated rows are packed each; rows with a null id come
with a null id; rows that agree in key and id are ordered by their ids' hash, and equal rows are interchangeable, so a lost
task is redone alike; a very long text is cut over as many sequences as it needs; a group of copies, whatever its
share, is spread over ranges, as the sort goes on by id; an empty table gives an empty result; further columns are
dropped, whatever their names. A worker holds one batch, one unfinished sequence and at most KEPT bytes of words.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

from tidemark.llm.common import stash
from tidemark.llm.textbytes import mix, parts

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 2  # id that closes a document
LENGTH = 4096
BUCKETS, DIMENSIONS, BITS = 256, 4, 15
REACH = 4.0  # projections of a unit vector lie within about four standard deviations
KEPT = 144 << 20  # bytes of words and ids that a worker remembers, about
SLICE = 3 << 20  # bytes of text tokenised together
LINE = 500  # runs of letters in a line
MARKS = string.punctuation.replace("'", "").encode()
IDS = np.dtype("<u4")


class Words:
    """Ids of a text, remembered by the pieces between blanks and marks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for lines of lower-case ASCII words: nothing to normalise, nothing to cut but blanks
        self.plain.normalizer = Lowercase()
        self.plain.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends_word[[k for w, k in self.whole.get_vocab().items() if w.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, bytes] = {b"": b""}
        self.kept = 0

    def _alone(self, pieces: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, IDS).tobytes() for e in self.whole.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]

    def _lines(self, letters: list[bytes], tokenizer: Tokenizer) -> list[bytes]:
        """Ids of runs of letters, tokenised in lines; a line in which some run is not one word is tokenised run by run."""
        lines = [letters[k : k + LINE] for k in range(0, len(letters), LINE)]
        out: list[bytes] = []
        for line, e in zip(lines, tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, IDS)
            closes = np.flatnonzero(self.ends_word[ids]) + 1
            if len(closes) == len(line) and closes[-1] == len(ids):
                raw, at = ids.tobytes(), (closes * IDS.itemsize).tolist()
                out.extend([raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)])
            else:
                out.extend(self._alone(line))
        return out

    def learn(self, pieces: list[bytes]) -> None:
        known = self.known
        words = {p for p in pieces if p.isalpha()}  # of bytes: ASCII letters
        beyond: set[bytes] = set()  # other runs of letters
        marks: set[bytes] = set()
        split: list[tuple[bytes, bytes, bytes, bytes]] = []  # letters between ASCII marks
        alone: list[bytes] = []
        for p in pieces:
            if p in words:
                continue
            core = p.strip(MARKS)
            if core.isalpha():
                words.add(core)
            elif core and not core.isascii() and core.decode("utf-8", "replace").isalpha():
                beyond.add(core)
            else:
                alone.append(p)
                continue
            if core != p:
                head, _, tail = p.partition(core)
                split.append((p, head, core, tail))
                marks.add(head)
                marks.add(tail)
        for fresh, tokenizer in ((words, self.plain), (beyond, self.whole)):
            fresh = list(fresh.difference(known))
            known.update(zip(fresh, self._lines(fresh, tokenizer), strict=True))
            self.kept += sum(map(len, fresh)) * 4 + len(fresh) * 180
        alone.extend(marks.difference(known, alone))
        known.update(zip(alone, self._alone(alone), strict=True))
        known.update([(p, known[head] + known[core] + known[tail]) for p, head, core, tail in split])
        self.kept += (len(alone) + len(split)) * 220 + sum(map(len, alone)) * 4

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column's rows, end to end, and their offsets (rows + 1). The distinct pieces of the column meet the memory once."""
        low = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        if odd.any():
            low = pc.if_else(pa.array(odd), pa.scalar("", low.type), low)
        lists = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if self.kept > KEPT:
            self._forget()
        found = list(map(self.known.get, distinct))
        if None in found:
            self.learn([p for p, x in zip(distinct, found, strict=True) if x is None])
            found = list(map(self.known.__getitem__, distinct))
        size = np.array(list(map(len, found)), np.int64) // IDS.itemsize
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        each = size[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = np.frombuffer(b"".join(found), IDS)[np.repeat(begin[which] - total[:-1], each) + np.arange(total[-1])]
        first = total[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if odd.any():
            rows = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for k in np.flatnonzero(odd):
                rows[k] = np.frombuffer(self._alone([texts[int(k)].as_py().encode()])[0], IDS)
            ids, first = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, first


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


def projected(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """float64[rows, DIMENSIONS] of rows' ids, laid end to end with offsets `first` (rows + 1)."""
    n = len(first) - 1
    bucket = (mix(ids.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), np.diff(first)) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    damped = np.sqrt(counts)
    return (damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)) @ _directions()


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (integers below 2**bits, one row each, at most 63 bits in all).

    From the highest bit down, each level's sub-cube is turned so that the curve runs through it from end to end: its
    coordinates are swapped with, or mirrored in, the first axis. The Gray code of what results, interleaved, is the place.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(axes):
            mirrored = (x[k] >> level & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(mirrored, below, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turned
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (x[k] >> level & 1)
    return key


def keys_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    cells = np.clip((projected(ids, first) + REACH) / (2 * REACH) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """-> (_id, _key, _ids): each row's place on the curve and its ids (little-endian 32-bit, two bytes each if all fit)."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    file = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(SparkFiles.get(file))
        narrow = np.dtype("<u2") if len(w.ends_word) <= 1 << 16 and end < 1 << 16 else IDS
        for batch in batches:
            for own in parts(batch, 1, SLICE):
                ids, first = w.ids_of(pc.fill_null(own.column(1), ""))
                ids, first = np.insert(ids, first[1:], end), first + np.arange(len(first))
                raw = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((first * narrow.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(narrow))])
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(keys_of(ids, first)), pa.array(np.full(len(own), narrow.itemsize, np.int32)), raw], names=["_id", "_key", "_width", "_ids"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _key bigint, _width int, _ids binary")


def _laid(rows: Iterator[tuple], length: int, base: int) -> Iterator[tuple]:
    """(id, ids as bytes) in order -> pieces (id, start, length, crc, doc_tokens, sequence, offset)."""
    size = IDS.itemsize
    held: list[tuple] = []  # of the unfinished sequence: (id, start, ids, doc_tokens)
    filled, sequence = 0, base
    for doc_id, ids in rows:
        n, at = len(ids) // size, 0
        while at < n:
            take = min(n - at, length - filled)
            held.append((doc_id, at, ids[at * size : (at + take) * size], n))
            filled, at = filled + take, at + take
            if filled == length:
                yield from _closed(held, sequence)
                held, filled, sequence = [], 0, sequence + 1
    for bit in range(length.bit_length() - 1, -1, -1):  # the rest, in powers of two
        if filled >> bit & 1:
            own, room = [], 1 << bit
            while room:
                doc_id, start, ids, n = held[0]
                take = min(room, len(ids) // size)
                own.append((doc_id, start, ids[: take * size], n))
                room -= take
                if take * size == len(ids):
                    held.pop(0)
                else:
                    held[0] = (doc_id, start + take, ids[take * size :], n)
            yield from _closed(own, sequence)
            sequence += 1


def _closed(held: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, n in held:
        took = len(ids) // IDS.itemsize
        yield doc_id, start, took, zlib.crc32(ids), n, sequence, offset
        offset += took


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH) -> DataFrame:
    """-> pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), all bigint but the id.

    `sequence_id` counts the sequences of a range, upwards from the range's number times 2**40. Tokens are written once, so
    that the range bounds and a lost task read them again instead of tokenising again; then one shuffle sorts them.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length is a power of two")
    rows = stash(tokenized(docs, id_col, text_col, vocabulary, end))
    order = ["_key", "_id", "_tie"]
    ranged = rows.withColumn("_tie", F.xxhash64("_ids")).repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_width", "_ids")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.cache_clear()  # a worker that has tokenised before needs its memory now
        pa.default_memory_pool().release_unused()

        def rows():
            for batch in batches:
                for doc_id, width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    yield doc_id, np.frombuffer(ids.as_buffer(), f"<u{width}").astype(IDS, copy=False).tobytes()

        types = [id_type, *[pa.int64()] * 6]
        base = TaskContext.get().partitionId() << 40
        pieces = _laid(rows(), length, base)
        while some := [p for _, p in zip(range(10_000), pieces)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types, strict=True)], names=names)

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    return ranged.mapInArrow(run, f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("_id", id_col)
