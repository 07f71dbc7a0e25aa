"""Cross-tokenizer alignment: which tokens of two tokenizers of one text end at the same bytes.

A Python step only tokenises, by a byte-level BPE (A, over a blank and the text) and a sentence-piece model (B, over the
text, which puts a blank before it itself). Neither ever joins across a blank or newline that follows a visible character, nor
(if the vocabularies bear it out) across a letter and a mark, so texts are cut there and every cut is an end that both share. The step gives, for each slice of texts, the distinct words
of the slice with the ids and byte ends of their tokens, and each text as the numbers of its words. The rest is Spark's own
higher-order functions: `array_intersect` of a word's end arrays lists the ends that both share; they cut its tokens into
groups, and the two tokens that end at one of them are linked; a text's groups and links are its words' in order. Links are
counted over the whole corpus per pair of ids; a link is a best one if no other A id is linked to its B id more often.

Handling of edge cases: null and empty texts, and those that A or B does not give back byte for byte (as where U+2581 stands
in a text), have no tokens: zeros and an empty groups text; strings of special tokens are plain text; a run of white space is
read with the word after it, at a text's end with the one before; a very long text is tokenised and aligned alone and
whole, a very long word in time linear in its length; rows that share an id are rows of their own; ids may be null; an empty
table gives an empty result; further columns are dropped, whatever their names. A worker holds one slice and remembers
at most KEPT bytes of words, about. Links are counted with partial sums before the shuffle; the counts travel to every task
only if a count proves them few, else both sides are shuffled by the pair, the counts copied to as many parts as a common
pair is dealt to.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidemark.llm.common import BROADCAST_ROWS, stash
from tidemark.llm.textbytes import parts

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
KEPT = 56 << 20  # bytes of words and tokens that a worker remembers, about
SLICE = 2 << 20  # bytes of text tokenised together
DEAL = 32  # parts that the links of one pair are dealt to where the counts are too many to send
LINE = 500  # words in a line
LETTER_MARK = r"([A-Za-z])([.,!?;:])"  # where no token of either vocabulary reaches across, marks are words of their own
HIGH = 1 << 32
SEARCHED = 32  # shared ends of a word that are searched for; those of longer words are marked by place
WORD = ["a_ids", "a_ends", "b_ids", "b_ends"]
TEXT = ["id", "n_a", "n_b", "order"]
UNIT = np.dtype("<u4")  # a token: its id, and above BITS how many bytes it covers
BITS = 20


def _byte_level() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: visible Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Both tokenizers, and the tokens of the words met lately."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        byte = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for w, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))
        if max(len(self.a_len), len(self.b_len)) > 1 << BITS or max(self.a_len.max(), self.b_len.max()) >= 1 << 32 - BITS:
            raise ValueError("a vocabulary beyond 2**20 tokens, or a token of 4096 bytes")
        self.apart = not any(re.search(LETTER_MARK.encode(), x) for x in (*self.a_bytes, *self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # word -> how many tokens A has, A's, B's
        self.bad: dict[str, tuple[bytes, bytes]] = {}  # words that come back otherwise, with what came back
        self.kept = 0

    def _piece(self, k: int) -> bytes:
        p = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(p[3:5], 16)])
        return b"" if self.b.is_control(k) or self.b.is_unknown(k) else p.replace("▁", " ").encode()

    def encoded(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both. B adds the blank that words begin with itself; what begins otherwise is read after a newline, and the tokens of
        B's blank and of that newline are left out."""
        a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        lead = [0 if w[0] == " " else 1 if w[0] == "\n" else 2 for w in words]
        b = self.b.encode([w[1:] if n == 0 else w if n == 1 else "\n" + w for w, n in zip(words, lead, strict=True)], num_threads=1)
        return a, [x[n:] for x, n in zip(b, lead, strict=True)]

    def learn(self, words: list[str]) -> None:
        """Words are tokenised in lines, which both cut at the words; a line that comes back otherwise, or has no token end there, word by word."""
        firm = [w for w in words if w[0] in " \n" and not w[-1].isspace()]
        lines = [firm[k : k + LINE] for k in range(0, len(firm), LINE)]
        alone = [w for w in words if w[0] not in " \n" or w[-1].isspace()]
        for line, ids, other in zip(lines, *self.encoded(["".join(x) for x in lines]), strict=True):
            ends = np.cumsum([len(w.encode()) for w in line])
            a, b = (_cut(np.array(x, np.int32), n, ends) for x, n in ((ids, self.a_len), (other, self.b_len)))
            raw = "".join(line).encode()
            if a is None or b is None or b"".join([self.a_bytes[k] for k in ids]) != raw or b"".join([self.b_bytes[k] for k in other]) != raw:
                alone.extend(line)
            else:
                self.known.update(zip(line, map(_joined, a, b), strict=True))
        for w, ids, other in zip(alone, *self.encoded(alone), strict=True) if alone else ():
            raw, a, b = w.encode(), b"".join([self.a_bytes[k] for k in ids]), b"".join([self.b_bytes[k] for k in other])
            if (a, b) != (raw, raw):
                self.bad[w] = a, b
            self.known[w] = _joined(*(_cut(np.array(x, np.int32), n, None)[0] for x, n in ((ids, self.a_len), (other, self.b_len))))
        self.kept += len(words) * 190 + sum(map(len, words)) * 6

    def of(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The tokens of a string column's distinct words, its rows' words as their numbers end to end, and the rows' offsets."""
        cut = lambda sign, t: pc.replace_substring(t, sign, "\0" + sign)
        odd = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        plain = pc.binary_join_element_wise("", pc.if_else(pa.array(odd), "", texts), " ")
        plain = pc.replace_substring_regex(plain, LETTER_MARK, "\\1\0\\2") if self.apart else plain
        lists = pc.split_pattern(cut(" ", cut("\n", plain)), "\0")
        coded = pc.dictionary_encode(lists.flatten())
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        keep = np.ones(len(which), bool)
        keep[first[:-1]] = False  # what stands before the first blank: nothing
        which, first = which[keep], first - np.arange(len(first))
        odd |= _rows_with(which, first, pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, -1)).to_numpy(zero_copy_only=False))
        if odd.any():
            number = {w: k for k, w in enumerate(words)}
            rows = [which[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for k in np.flatnonzero(odd):
                rows[k] = np.array([number.setdefault(w, len(number)) for w in words_of(" " + texts[int(k)].as_py())], which.dtype)
            words, which, first = list(number), np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        empty = np.flatnonzero(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        which, first = _without(which, first, empty)
        used = np.zeros(len(words), bool)
        used[which] = True
        words, which = list(compress(words, used.tolist())), (np.cumsum(used) - 1)[which]
        if self.kept > KEPT:
            self.forget()
        found = list(map(self.known.get, words))
        if None in found:
            self.learn([w for w, x in zip(words, found, strict=True) if x is None])
            found = list(map(self.known.__getitem__, words))
        if self.bad:
            wrong = np.array([w in self.bad for w in words], bool)
            spoilt = [k for k in np.flatnonzero(_rows_with(which, first, wrong)) if not self._whole([words[w] for w in which[first[k] : first[k + 1]]])]
            which, first = _without(which, first, np.array(spoilt, np.int64))
        return found, which, first

    def _whole(self, words: list[str]) -> bool:
        """Whether both give the words back, end to end."""
        return all("".join(words).encode() == b"".join([self.bad[w][side] if w in self.bad else w.encode() for w in words]) for side in (0, 1))


def _cut(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray | None) -> list[bytes] | None:
    """Tokens as UNITs, cut at byte offsets `ends` (None: not at all); None if no token ends at one of them."""
    n = lengths[ids]
    raw = (ids.astype(UNIT) | n.astype(UNIT) << BITS).tobytes()
    if ends is None:
        return [raw]
    stops = np.cumsum(n)
    at = np.searchsorted(stops, ends)
    if at[-1] != len(ids) - 1 or (stops[at] != ends).any():
        return None
    at = ((at + 1) * UNIT.itemsize).tolist()
    return [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]


def _joined(a: bytes, b: bytes) -> bytes:
    return (len(a) // UNIT.itemsize).to_bytes(UNIT.itemsize, "little") + a + b


def _rows_with(which: np.ndarray, first: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Whether a row holds a marked word."""
    return np.diff(np.concatenate([[0], np.cumsum(marked[which])])[first]) > 0 if len(marked) else np.zeros(len(first) - 1, bool)


def _without(which: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with some rows emptied."""
    if not len(rows):
        return which, first
    n = np.diff(first)
    keep = np.ones(len(n), bool)
    keep[rows] = False
    return which[np.repeat(keep, n)], np.cumsum([0, *np.where(keep, n, 0)])


def words_of(text: str) -> list[str]:
    """`text`, which begins with a blank, cut before every blank and newline that follows a visible character."""
    at = [k for k, c in enumerate(text) if k and c in " \n" and not text[k - 1].isspace()]
    if at and text[at[-1] :].isspace():
        at.pop()  # white space at the end is read with the word before it
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


@lru_cache(maxsize=2)
def tokens(byte_bpe: str, pieces: str) -> Tokens:
    return Tokens(byte_bpe, pieces)


def _lists(found: list[bytes]) -> list[tuple[np.ndarray, pa.Array, pa.Array]]:
    """For A and for B: how many tokens each word has, their ids, the byte ends."""
    flat = np.frombuffer(b"".join(found), UNIT)
    size = np.array(list(map(len, found)), np.int64) // UNIT.itemsize
    begin = np.cumsum(size) - size
    n_a = flat[begin].astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(begin, size)
    ours = place <= np.repeat(n_a, size)
    out = []
    for n, units in ((n_a, flat[ours & (place > 0)]), (size - n_a - 1, flat[~ours])):
        first = np.concatenate([[0], np.cumsum(n)])
        total = np.concatenate([[0], np.cumsum(units >> BITS, dtype=np.int64)])
        lists = (units & ((1 << BITS) - 1), total[1:] - np.repeat(total[first[:-1]], n))
        out.append((n, *(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in lists)))
    return out


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Slices (words, texts): an array of (a_ids, a_ends, b_ids, b_ends) and one of (id, n_a, n_b, order), order numbering the words from 0."""
    for f in (byte_bpe, pieces):
        docs.sparkSession.sparkContext.addFile(f)
    names = [f.rsplit("/", 1)[-1] for f in (byte_bpe, pieces)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(*map(SparkFiles.get, names))
        for batch in batches:
            for own in parts(batch, 1, SLICE):
                found, which, first = t.of(pc.fill_null(own.column(1), ""))
                sides = _lists(found)
                words = pa.StructArray.from_arrays([x for _, *lists in sides for x in lists], WORD)
                n = [pa.array(np.diff(np.concatenate([[0], np.cumsum(each[which])])[first])) for each, *_ in sides]
                order = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(which.astype(np.int32)))
                texts = pa.StructArray.from_arrays([own.column(0), *n, order], TEXT)
                yield pa.RecordBatch.from_arrays([_one(words), _one(texts)], names=["words", "texts"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    word = ", ".join(f"{c}: array<int>" for c in WORD)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"words array<struct<{word}>>, texts array<struct<id: {kind}, n_a: bigint, n_b: bigint, `order`: array<int>>>")


def _let(value: Column, body) -> Column:
    """`body(value)`, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(ends: Column) -> Column:
    """One byte for each byte of the text: `1` where a shared end lies. Found by place, where a list would have to be searched."""
    gap = lambda e, i: e - F.coalesce(F.get(ends, i - 1), F.lit(0)) - 1
    return F.array_join(F.transform(ends, lambda e, i: F.concat(F.repeat(F.lit("0"), gap(e, i)), F.lit("1"))), "").cast("binary")


def _grouped(ids: Column, ends: Column, shared_end) -> Column:
    """Each group's ids, comma-joined, in order; and an empty text after the last."""
    shared = lambda i: shared_end(F.get(ends, i))
    return F.split(F.array_join(F.transform(ids, lambda x, i: F.concat(x.cast("string"), F.when(shared(i), F.lit(";")).otherwise(F.lit(",")))), ""), ";")


def _word(w: Column) -> Column:
    """(groups, links) of a word: its groups' text, and for each end that both share the two tokens' ids in one number.

    Where A and B end all their tokens together every group is a pair; other words are cut at their shared ends.
    """
    paired = lambda e: (F.size(e) == F.size(w["a_ids"])) & (F.size(e) == F.size(w["b_ids"]))
    pairs = F.struct(
        F.array_join(F.zip_with(w["a_ids"], w["b_ids"], lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string"))), ";").alias("groups"),
        F.zip_with(w["a_ids"], w["b_ids"], lambda a, b: a * F.lit(HIGH) + b).alias("links"),
    )
    return _let(F.array_intersect(w["a_ends"], w["b_ends"]), lambda e: F.when(paired(e), pairs).otherwise(_cut_word(w, e)))


def _cut_word(w: Column, ends: Column) -> Column:
    """Groups and links of a word cut at `ends`, which are looked up by search in a short word and by place in a long one."""
    last = lambda g: F.substring_index(g, ",", -1).cast("bigint")
    pairs = lambda shared: F.arrays_zip(_grouped(w["a_ids"], w["a_ends"], shared).alias("a"), _grouped(w["b_ids"], w["b_ends"], shared).alias("b"))
    by_place = _let(_marked(ends), lambda marks: pairs(lambda e: F.substring(marks, e, F.lit(1)) == F.lit(b"1")))
    zipped = F.when(F.size(ends) <= SEARCHED, pairs(lambda e: F.array_contains(ends, e))).otherwise(by_place)
    return _let(F.slice(zipped, F.lit(1), F.size(ends)), lambda g: F.struct(
        F.array_join(F.transform(g, lambda x: F.concat(x["a"], F.lit("|"), x["b"])), ";").alias("groups"),
        F.transform(g, lambda x: last(x["a"]) * F.lit(HIGH) + last(x["b"])).alias("links"),
    ))


def aligned(slices: DataFrame) -> DataFrame:
    """-> (id, n_a, n_b, sha, links): each text's tokens, hashed groups and links (A's id times HIGH plus B's)."""
    of = lambda t, words, part: F.transform(t["order"], lambda k: F.get(words, k)[part])
    row = lambda t, words: F.struct(
        t["id"].alias("id"), t["n_a"].alias("n_a"), t["n_b"].alias("n_b"), F.sha2(F.array_join(of(t, words, "groups"), ";"), 256).alias("sha"), F.flatten(of(t, words, "links")).alias("links")
    )
    made = _let(F.transform("words", _word), lambda words: F.transform(F.col("texts"), lambda t: row(t, words)))
    return slices.select(F.inline(made))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """-> (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of `docs`."""
    made = aligned(tokenized(docs, id_col, text_col, byte_bpe, pieces))
    n = F.size("links").cast("long")
    rows = stash(made.select(F.monotonically_increasing_id().alias("_row"), "id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), F.when(n > 0, F.col("sha")).otherwise("").alias("groups_sha256"), "links"))
    links = rows.select("_row", F.explode("links").alias("_pair"))
    counts = stash(links.groupBy("_pair").agg(F.count("*").alias("_count")))
    counts = counts.withColumn("_best", F.col("_count") == F.max("_count").over(Window.partitionBy(F.col("_pair") % HIGH)))
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = links.join(F.broadcast(counts), "_pair")
    else:
        per_row = links.groupBy("_row", "_pair").agg(F.count("*").alias("_times")).withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(DEAL)))
        met = per_row.join(counts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEAL - 1).cast("bigint")))), ["_pair", "_part"])
    times = F.col("_times") if "_times" in met.columns else F.lit(1)
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("_best"), times).otherwise(0)).alias("_n_best"), F.sum(F.col("_count") * times).alias("_count_sum"))
    out = rows.drop("links").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("_n_best").alias("n_best"), zero("_count_sum").alias("count_sum"), "groups_sha256")
