"""Alignment, packing and fill-in-middle against plain Python."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from tidemark.llm import alignment, fill_in_middle, packing, queries

TEXTS = [
    None, "", " ", "\n", "a", " a  b ", "two\n\nlines\n", "tab\tand\x0bfeed \t x", "no<|endoftext|>special <|startoftext|> <s></s> <unk>", "it's 'tis don't we'll 12.5% --!? a.b", "▁mark a▁b", "NUL\0here \0",
    "é é ça, été! «oui» — …! ΣΣ İx ² Ⅷa K", "日本語 の 文章。 한국어 🙂🙂 👩‍👩‍👧", "x" * 3000, "word " * 500, "UPPER lower MiXeD,punct;uated(text)", "ends with blanks   ", " wide blank  ", "\x1cfs \x1d", "http://a.b/c?d=e&f=1 me@x.org +1 (555) 123",
]


@pytest.fixture(scope="module")
def mixed(spark):
    """TEXTS with an id each (one missing, one shared), twice, and a clashing column."""
    rows = [(None if k == 3 else 4 if k == 5 else k, t, "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows, "doc_id bigint, text string, text_ string").withColumnRenamed("text_", "_text")


# -- op11 --------------------------------------------------------------------------------------------------
def aligned_plainly(rows):
    """(id, text) rows -> the rows of op11, from whole texts."""
    t = alignment.Tokens(alignment.BYTE_BPE, alignment.PIECES)
    made, counts = [], Counter()
    for i, text in rows:
        want = (" " + (text or "")).encode()
        a, b = (t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [t.a_bytes[k] for k in a], [t.b_bytes[k] for k in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = set(ends_a) & set(ends_b)
        links = list(zip([k for k, e in zip(a, ends_a, strict=True) if e in both], [k for k, e in zip(b, ends_b, strict=True) if e in both], strict=True))
        sides = []
        for ids, ends in ((a, ends_a), (b, ends_b)):
            groups = [[]]
            for k, e in zip(ids, ends, strict=True):
                groups[-1].append(str(k))
                if e in both:
                    groups.append([])
            sides.append([",".join(g) for g in groups[:-1]])
        made.append((i, len(a), len(b), links, ";".join(f"{x}|{y}" for x, y in zip(*sides, strict=True))))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if links else "")
        for i, n_a, n_b, links, g in made
    ]


@pytest.mark.parametrize("few", [True, False])
def test_alignment_of_odd_texts(spark, mixed, monkeypatch, few):
    """Also with counts that are too many to send."""
    if not few:
        monkeypatch.setattr(alignment, "BROADCAST_ROWS", 5)
    got = sorted(map(tuple, alignment.align(mixed).collect()), key=repr)
    assert got == sorted(aligned_plainly([(r.doc_id, r.text) for r in mixed.collect()]), key=repr)
    assert sum(r[1] == 0 for r in got) == 6  # null, empty and U+2581, each twice


def test_alignment_of_the_table(spark, texts):
    got = sorted(map(tuple, queries.op11_tokenizer_alignment(spark, SF).collect()), key=repr)
    assert got == sorted(aligned_plainly(texts.items()), key=repr)


def test_alignment_forgets_and_slices(spark, mixed, monkeypatch):
    """A memory without room, and texts read one by one, change nothing."""
    t = alignment.Tokens(alignment.BYTE_BPE, alignment.PIECES)
    column = pa.array([x or "" for x in TEXTS])
    found, which, first = t.of(column)
    rows = [[found[k] for k in which[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    monkeypatch.setattr(alignment, "KEPT", 0)
    for k in range(len(TEXTS)):
        found, which, _ = t.of(column.slice(k, 1))
        assert [found[w] for w in which] == rows[k]


def test_words_are_cut_at_shared_ends():
    for t in TEXTS:
        if t:
            cut = alignment.words_of(" " + t)
            assert "".join(cut) == " " + t and all(w[0] in " \n" for w in cut) and not any(w[-1].isspace() for w in cut[:-1])


def test_alignment_of_nothing_and_odd_rows(odd, nothing):
    assert alignment.align(nothing).collect() == []
    got = sorted(map(tuple, alignment.align(odd).collect()), key=repr)
    assert got == sorted(aligned_plainly([(r.doc_id, r.text) for r in odd.collect()]), key=repr)


# -- op12 --------------------------------------------------------------------------------------------------
def check_packed(rows, pieces, length=packing.LENGTH):
    """Every id of every row in one piece, sequences without gaps, full or of a power of two."""
    whole = Tokenizer.from_file(packing.VOCABULARY)
    ids = [np.array(e.ids + [2], np.uint32) for e in whole.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    expected, seen, sequences = Counter((i, len(x)) for (i, _), x in zip(rows, ids, strict=True)), Counter(), defaultdict(list)
    possible = defaultdict(list)
    for (i, _), x in zip(rows, ids, strict=True):
        possible[i, len(x)].append(x)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        assert p.ids_crc32 in {zlib.crc32(x[p.start : p.start + p.length].tobytes()) for x in possible[p.doc_id, p.doc_tokens]}
        for k in range(p.start, p.start + p.length):
            seen[p.doc_id, p.doc_tokens, k] += 1
    assert seen == Counter({(i, n, k): c for (i, n), c in expected.items() for k in range(n)})
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length and at & (at - 1) == 0
        short += at < length
    return len(sequences), short


def test_packing_of_the_table(spark, texts):
    sequences, short = check_packed(list(texts.items()), queries.op12_packing(spark, SF).collect())
    assert short < 0.5 * sequences  # few texts here: each range of the sort ends with short sequences


def test_packing_of_odd_rows(mixed, odd, nothing):
    for d in (mixed, odd):
        check_packed([(r.doc_id, r.text) for r in d.collect()], packing.pack(d, length=64).collect(), 64)
    assert packing.pack(nothing).collect() == []


def test_words_forgotten_and_whole(monkeypatch):
    whole = Tokenizer.from_file(packing.VOCABULARY)
    want = [e.ids for e in whole.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    w = packing.Words(packing.VOCABULARY)
    for kept in (packing.KEPT, 0, 0):
        monkeypatch.setattr(packing, "KEPT", kept)
        ids, first = w.ids_of(pa.array([t or "" for t in TEXTS]))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_takes_unit_steps(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark, docs):
    """Documents that share a sequence share their language, and copies their sequence, far more often than by chance."""
    base = SF.replace("sf0.001", "sf0.01")
    d = spark.read.parquet(f"{base}/documents.parquet").where("lang is not null")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    shares, chance = [], Counter(lang.values())
    by = defaultdict(set)
    for p in packing.pack(d).collect():
        by[p.sequence_id].add(p.doc_id)
    for ids in by.values():
        own = Counter(lang[i] for i in ids)
        if len(ids) > 1:
            shares.append(sum(n * (n - 1) for n in own.values()) / (len(ids) * (len(ids) - 1)))
    alone = sum(n * n for n in chance.values()) / len(lang) ** 2
    assert np.mean(shares) > alone + 0.5 * (1 - alone)


def test_length_must_be_a_power_of_two(nothing):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(nothing, length=1000)


# -- op13 --------------------------------------------------------------------------------------------------
def cut_plainly(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, sha(text), sha(text)
    out, form = (f"<S>{tail}<P>{head}<M>{middle}", "spm") if h4 % 100 < 50 else (f"<P>{head}<S>{tail}<M>{middle}", "psm")
    return i, n, form, len(head), len(middle), sha(out), sha(text)


def test_fill_in_middle_of_the_table(spark, texts):
    got = sorted(map(tuple, queries.op13_fill_in_middle(spark, SF).collect()), key=repr)
    assert got == sorted((cut_plainly(i, t) for i, t in texts.items()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet{'/*.parquet' if os.path.isdir(SF + '/documents.parquet') else ''}'")
    cursor = con.execute(queries.ORACLE_SQL["op13_fill_in_middle"])
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")]
    assert sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr) == got


def test_fill_in_middle_of_odd_rows(spark, mixed, odd, nothing):
    sentinels = spark.createDataFrame([(1, "a <P> b\nc"), (2, "<M>"), (3, "<S"), (4, "x<\n<S\n<P\n>"), (5, "\n"), (6, "\n\n\nlast")], "doc_id bigint, text string")
    for d in (mixed, odd, sentinels):
        cut = fill_in_middle.fill_in_middle(d)
        assert cut.columns == [*d.columns, "units", "form", "prefix_chars", "middle_chars", "output", "restored"]
        assert cut.where(F.coalesce("text", F.lit("")) != F.col("restored")).count() == 0
        got = cut.select("doc_id", "units", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("restored", 256)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((cut_plainly(r.doc_id, r.text) for r in d.collect()), key=repr)
    assert fill_in_middle.fill_in_middle(nothing).collect() == []


def test_fill_in_middle_by_words_and_shares(docs):
    assert fill_in_middle.boundaries(fill_in_middle.code_points("ab  cd\n\ne"), "word").tolist() == [0, 2, 4, 6, 7, 8, 9]
    assert fill_in_middle.boundaries(fill_in_middle.code_points("é🙂"), "char").tolist() == [0, 1, 2]
    forms = Counter(r.form for r in fill_in_middle.fill_in_middle(docs, unit="word", percent=40, spm_percent=0).select("form").collect())
    n = sum(forms.values())
    assert set(forms) == {"plain", "psm"} and 0.25 * n < forms["psm"] < 0.55 * n
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.fill_in_middle(docs, unit="page")
