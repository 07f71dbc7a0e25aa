"""Jaccard join, substring dedup, SentencePiece, classifiers and the pipeline against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import jaccard_join, quality, sentencepiece_codec, substring_dedup, toxicity
from tidemark.llm.components import components
from tidemark.llm.textbytes import Text, chunks, shingles


def words(text):
    raw = (text or "").encode()
    return re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


# -- bytes ---------------------------------------------------------------------------------------------------
def test_words_and_hashes():
    rows = ["Hello, world", None, "", "éa 1b", "tail", "Hello"]
    t = Text(pa.array(rows))
    starts, ends, first = t.words()
    got = [[t.lowered()[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [words(r) for r in rows]
    h = t.hashes(starts, ends)
    assert h[0] == h[-1] and len(set(h.tolist())) == 5
    many = pa.array([f"w{k} " * (k % 50) for k in range(3000)])
    whole = np.concatenate([shingles(t)[0] for _, t in chunks(many, 1 << 30)])
    assert (np.concatenate([shingles(t)[0] for _, t in chunks(many, 500)]) == whole).all()
    assert [len(t) for _, t in chunks(many.slice(5, 7), 100)] and sum(len(t) for _, t in chunks(many.slice(5, 7), 100)) == 7


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- op9 ---------------------------------------------------------------------------------------------------
def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = words(t)
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def links_of(texts, threshold=0.8):
    """(class of each id, number of linked documents) by comparing all pairs that share a shingle."""
    s = sets_of(texts)
    inverted = defaultdict(list)
    for i, x in s.items():
        for sh in x:
            inverted[sh].append(i)
    up, degree = {i: i for i in s}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in s.items():
        for j, n in Counter(j for sh in x for j in inverted[sh] if j > i).items():
            if n >= threshold * (len(x) + len(s[j]) - n):
                degree[i] += 1
                degree[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (root(i), degree[i]) for i in s}


def test_jaccard_of_the_table(spark, docs, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == links_of(texts)


def test_jaccard_groups_above_the_limit(spark):
    """A crowd of near copies, one of exact copies and boilerplate, with buckets of at most ten."""
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(500)]
    head = " ".join(rng.choices(vocab, k=12))
    crowd = rng.choices(vocab, k=120)
    texts = {}
    for k in range(60):
        w = list(crowd)
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts[k] = " ".join(w)
    texts |= {100 + k: head + " exact copy of one and the same text" for k in range(30)}
    texts |= {200 + k: head + " " + " ".join(rng.choices(vocab, k=8)) for k in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(d, limit=10).collect()}
    want = links_of(texts)
    assert got == want
    kept = {r.doc_id for r in jaccard_join.drop_near_copies(d, limit=10).collect()}
    assert kept == {c for c, _ in want.values()}


def test_jaccard_edges(odd, nothing):
    got = jaccard_join.jaccard_classes(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.n_copies, r.n_links))
    assert by[6] == by[7] == {(6, 3, 2)} and by[1] == {(1, 1, 0)} and by[2] == {(2, 1, 0)} and by[4] == {(4, 1, 0)}
    kept = jaccard_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 0 and kept.count() == odd.count() - 2
    assert jaccard_join.jaccard_classes(nothing).count() == 0 and jaccard_join.drop_near_copies(nothing).count() == 0


def test_jaccard_copies_without_an_id(spark):
    """A copy without an id names no class, and switches the dropping of none off."""
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(4)]
    near = [*texts[1][:-1], "other"]
    rows = [(None, texts[0]), (5, texts[0]), (6, texts[0]), (None, texts[1]), (8, near), (9, near), (None, texts[2]), (None, texts[2]), (11, texts[3])]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in jaccard_join.jaccard_classes(d).collect())
    assert got == Counter([(None, 5, 3, 2), (5, 5, 3, 2), (6, 5, 3, 2), (None, 8, 1, 2), (8, 8, 2, 2), (9, 8, 2, 2), (None, None, 2, 1), (None, None, 2, 1), (11, 11, 1, 0)])
    kept = sorted(r.doc_id or 0 for r in jaccard_join.drop_near_copies(d).collect())
    assert kept == [0, 0, 0, 0, 5, 8, 11]


def test_near_copies_of_rows_that_share_an_id(spark):
    """A row goes only if its own text is a copy: nothing unique is lost on equal or missing ids."""
    rng = random.Random(14)
    p, u, v, w = (" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(4))
    rows = [(1, p), (7, p), (7, u), (None, v), (None, w), (9, w + " end"), (9, w), (5, u + "."), (5, u), (5, u), (3, "few"), (3, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_row", F.lit("clash")).coalesce(1)
    kept = jaccard_join.drop_near_copies(d)
    assert kept.columns == d.columns
    # of u's four rows the first of the least id stays; a row without an id stays and names no class
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, p), (5, u + "."), (None, v), (None, w), (9, w + " end"), (3, "few"), (3, None)])


def test_bands_lose_no_link(spark):
    """A chain of texts of growing length, in blocks of three: only neighbours are linked."""
    rng = random.Random(16)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    sizes = [20]
    while sizes[-1] < 3000:
        sizes += [int(sizes[-1] * 1.18)]
    texts = {k: " ".join(ws[:n]) for k, n in enumerate(sizes)} | {100 + k: " ".join([*ws[:n], "end"]) for k, n in enumerate(sizes)}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(d, limit=3, slack=0.3, recall=0.99999).collect()}
    assert got == links_of(texts)


# -- op10 --------------------------------------------------------------------------------------------------
def split_sentences(text):
    """Text pieces with a word each; wordless pieces join the one before, or the first."""
    parts = re.findall(r"(?:[^\n]*?[.!?] |[^\n]*?\n|[^\n]+$)", text or "")
    assert "".join(parts) == (text or "")
    out = []
    for p in parts:
        if words(p) and not (len(out) == 1 and not words(out[0])):
            out.append(p)
        elif out:
            out[-1] += p
        else:
            out.append(p)
    return out if out and words(out[0]) else []


def removed(texts, least=25):
    """For each id the numbers of repeated and of removed sentences, and the text left."""
    spans = defaultdict(list)
    sents = {i: split_sentences(t) for i, t in texts.items()}
    for i in sorted(texts):
        ws = [words(s) for s in sents[i]]
        n, runs = len(ws), set()
        for a in range(n):
            total = 0
            for b in range(a, n):
                total += len(ws[b])
                if total >= least and b > a:
                    runs.add((a, b))
                    break
            total = 0
            for b in range(a, -1, -1):
                total += len(ws[b])
                if total >= least and b < a:
                    runs.add((b, a))
                    break
            if len(ws[a]) >= 2 * least:
                runs.add((a, a))
            if a + 2 < n and sum(map(len, ws[a : a + 3])) >= 12:
                runs.add((a, a + 2))
        for a, b in sorted(runs):
            spans[tuple(w for x in ws[a : b + 1] for w in x)].append((i, a, b))
    gone, seen = defaultdict(set), defaultdict(set)
    for places in spans.values():
        if len(places) > 1:
            for k, (i, a, b) in enumerate(places):
                seen[i] |= set(range(a, b + 1))
                gone[i] |= set(range(a, b + 1)) if k else set()
    return {i: (len(sents[i]), len(gone[i]), "".join(s for k, s in enumerate(sents[i]) if k not in gone[i]) if gone[i] else texts[i]) for i in texts}


def test_repeats_of_the_table(spark, docs, texts):
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == removed(texts)


def test_planted_repeats(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(4000)]
    sentence = lambda n: " ".join(rng.choices(vocab, k=n)) + "."
    texts, passages = {}, [" ".join(sentence(rng.randint(3, 30)) for _ in range(9)) for _ in range(5)]
    for k in range(40):
        own = [" ".join(sentence(rng.randint(1, 20)) for _ in range(rng.randint(1, 6))) for _ in range(2)]
        texts[k] = own[0] + "\n" + (passages[k % 5] + "\n" if k < 30 else "") + own[1]
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in substring_dedup.remove_repeats(d).collect()}
    assert got == removed(texts)
    assert all(got[k][1] >= 9 for k in range(5, 30)) and all(got[k][1] == 0 for k in [*range(5), *range(30, 40)])


def test_short_passages_that_many_share(spark):
    """Three sentences of 16 words in all of 50 documents go from all but the first; two, or three of 11 words, stay."""
    rng = random.Random(21)
    own = lambda: " ".join(f"w{rng.randrange(90_000)}" for _ in range(9)) + "."
    notice, two, brief = "All rights are reserved here. Do not copy these pages. Ask us first by letter or mail.", "See the next page. It goes on.", "One two three four. Five six seven. Eight nine ten eleven."
    texts = {k: f"{own()}\n{notice}\n{own()}\n{two}\n{own()}\n{brief}\n{own()}" for k in range(50)}
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in substring_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == removed(texts) and [n for _, n, _ in got.values()].count(3) == 49 and got[0][1] == 0
    assert all(notice not in t and two in t and brief in t for k, (_, _, t) in got.items() if k)


def test_repeat_edges(odd, nothing):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count() and {r.text for r in got if r.doc_id in (1, 2)} == {None, ""}
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("shared", [None, 7])
def test_repeats_of_rows_that_share_an_id(spark, shared):
    """Rows with equal or missing ids are documents of their own: their spans cut no other row's sentences."""
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n)) + "."
    clean = lambda n: " ".join(sentence(9) for _ in range(n))
    passage, other = clean(8), clean(8)
    texts = [clean(6) + "\n" + passage, clean(2), other, clean(3) + "\n" + other, clean(20), clean(1)]
    last = clean(2) + "\n" + passage
    d = spark.createDataFrame([(shared, t) for t in texts] + [(9, last)], "doc_id bigint, text string").coalesce(1)
    got = {r.text: (r.doc_id, r.n_repeated, r.n_removed) for r in substring_dedup.remove_repeats(d).collect()}
    want = {t: (shared, 0, 0) for t in texts} | {texts[0]: (shared, 8, 0), other: (shared, 8, 0)}
    del want[texts[3]]
    assert got == want | {texts[3][: -len(other)]: (shared, 8, 8), last[: -len(passage)]: (9, 8, 8)}


# -- op8 ---------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def unigram():
    """The same pieces and scores in the library's own lattice, whose first of n best is the best."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def best_score(sp, ids):
    return sum(sp.get_score(i) for i in ids)


def test_viterbi_is_optimal(texts, unigram):
    p = sentencepiece_codec.Pieces(sentencepiece_codec.MODEL)
    ws = sorted({w for t in texts.values() for w in (t or "").split(" ") if w and "\n" not in w and "▁" not in w})[::7]
    p.learn(set(ws))
    for w in ws:
        mine, theirs = list(p.known[w]), unigram.nbest_encode(w, nbest_size=2)[0]
        if not any(unigram.is_byte(i) or unigram.is_unknown(i) for i in [*mine, *theirs]):
            assert best_score(unigram, mine) == pytest.approx(best_score(unigram, theirs)), w


def test_viterbi_against_all_segmentations():
    p = sentencepiece_codec.Pieces(sentencepiece_codec.MODEL)
    ws = ["entebest", "there", "themes", "of", "q", "xylem", "réeux"]
    p.learn(set(ws))

    def best(marked):
        """Largest sum over all cuts into pieces."""
        return max([p.score.get(marked, float("-inf"))] + [p.score[marked[:k]] + best(marked[k:]) for k in range(1, len(marked)) if marked[:k] in p.score])

    for w in ws:
        names = {k: piece for piece, k in p.id.items()}
        assert sum(p.score[names[k]] for k in p.known[w]) == best("▁" + w)


def test_shared_prefixes_change_nothing():
    together, apart = sentencepiece_codec.Pieces(sentencepiece_codec.MODEL), sentencepiece_codec.Pieces(sentencepiece_codec.MODEL)
    ws = {"the", "them", "theme", "themes", "thing", "t", "", "therapy", "日本", "日本語", "e\u0301", "▁", "a▁b"}
    together.learn(ws)
    for w in ws:
        apart.learn({w})
    assert together.known == apart.known


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    """Long blank-free texts, over and over, leave nothing behind; forgetting changes no ids."""
    monkeypatch.setattr(sentencepiece_codec, "KEPT", 20_000)
    bounded, free = sentencepiece_codec.Pieces(sentencepiece_codec.MODEL), sentencepiece_codec.Pieces(sentencepiece_codec.MODEL)
    rng = random.Random(3)
    texts = ["日本語" * 2000 + str(k) for k in range(5)] * 3 + [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(30)] + [None, "", " "]
    for t in texts:
        ids = bounded.encode_all([t, t])[0]
        assert ids == (None if t is None else [i for w in t.split(" ") for i in free.segmented({w})[w]] if t else [])
        assert bounded.kept <= 20_000 and all(len(w) <= sentencepiece_codec.LONGEST_KEPT for w in bounded.known)
        assert bounded.kept == sum(map(sentencepiece_codec._size, bounded.known.items()))


def test_round_trip(spark, docs, odd, nothing):
    e = sentencepiece_codec.encode(docs)
    assert e.where("not round_trip").count() == 0 and e.count() == docs.count()
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(e).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    o = sentencepiece_codec.encode(odd.withColumn("ids", F.lit("clash")))
    assert o.where("text is not null and not round_trip").count() == 0 and o.where("text is null and ids is not null").count() == 0
    assert o.where("text = ''").first().ids == [] and sentencepiece_codec.encode(nothing).count() == 0


# -- op6, op7 ------------------------------------------------------------------------------------------------
def auc(y, s):
    r = np.argsort(np.argsort(s, kind="stable")) + 1.0
    p = y.sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_machine_equals_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), np.zeros(1), np.ones(1))
    idx, x = np.array([1, 5, 7, 9]), rng.normal(size=4)
    direct = 0.3 + m.linear[idx] @ x + sum(m.factors[idx[a]] @ m.factors[idx[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.margin(np.array([0, 4]), idx, x)[0][0] == pytest.approx(direct)


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.75)])
def test_held_out(spark, module, label, least):
    base = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = module.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert out.count() == docs.count() and auc(rows[label].to_numpy(), rows.score.to_numpy()) > least
    assert (rows.predicted[rows[label] == (1 if label == "quality" else 0)] == (1 if label == "quality" else 0)).mean() > 0.95


def test_scores_see_no_labels_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs.withColumn("lang", F.lit("xx")), turned).collect()}
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, odd, nothing, module):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = module.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert module.classify(odd, labels.limit(0)).count() == odd.count() and module.classify(nothing, labels).count() == 0


def made_texts(n=400, seed=2):
    """(row offsets, slots, toxic): toxic rows hold words of one of three groups, and all rows common words."""
    rng = np.random.default_rng(seed)
    toxic = (rng.random(n) < 0.3).astype(np.float32)
    rows = [np.unique(np.concatenate([rng.integers(1000, 1400, 30), 10 * (1 + rng.integers(3)) + rng.integers(0, 4, 3) if toxic[k] and rng.random() < 0.95 else []]).astype(np.int32)) for k in range(n)]
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), toxic


def test_telling_words_by_a_plain_count():
    first, slots, toxic = made_texts()
    n, p = len(toxic), toxic.mean()
    want = []
    for s in sorted(set(slots.tolist())):
        docs = [k for k in range(n) if s in slots[first[k] : first[k + 1]]]
        hit, every = sum(toxic[k] for k in docs), len(docs)
        if every >= 4 and hit >= every * p and (hit - every * p) ** 2 / (every * p * (1 - p) * (1 - every / n)) > 15:
            want.append(s)
    assert toxicity.telling(first, slots, toxic).tolist() == want and set(want) >= {10, 20, 30}


def test_linear_model_by_a_plain_loop():
    rng = np.random.default_rng(5)
    x, seen, y = (rng.random((60, 3)) < 0.5).astype(np.float32), [rng.random(60).astype(np.float32)], (rng.random(60) < 0.5).astype(np.float32)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w, m, v = [0.0] * 4 + [float(np.log(p / (1 - p)))], [0.0] * 5, [0.0] * 5
    for t in range(1, 401):
        g = [0.0] * 5
        for r in range(60):
            row = [*map(float, x[r]), float(seen[0][r]), 1.0]
            e = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, row, strict=True)))) - float(y[r])
            g = [a + e * b / 60 for a, b in zip(g, row, strict=True)]
        for k in range(5):
            g[k] += 2e-4 * w[k] if k < 4 else 0
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] -= 0.1 * (1 - (t - 1) / 400) * (m[k] / (1 - 0.9**t)) / ((v[k] / (1 - 0.99**t)) ** 0.5 + 1e-8)
    assert toxicity.fit_linear(x, seen, y, rounds=400) == pytest.approx(w, abs=1e-6)
    assert toxicity.predict(np.array(w), x, seen)[3] == pytest.approx(1 / (1 + np.exp(-(sum(w[k] * x[3, k] for k in range(3)) + w[3] * seen[0][3] + w[4]))))


def test_chain_by_a_plain_loop():
    """Each model's earlier probabilities come, in training, from models that have not seen the row; then from all before it."""
    first, slots, toxic = made_texts()
    chain = toxicity.fit_chain(first, slots, toxic)
    x = np.zeros((len(toxic), 0), np.float32)
    for s in toxicity.telling(first, slots, toxic):
        x = np.concatenate([x, np.array([[float(s in slots[first[k] : first[k + 1]])] for k in range(len(toxic))], np.float32)], axis=1)
    kind = np.full(len(toxic), -1)
    kind[toxic > 0] = toxicity.clusters(x[toxic > 0], 3)
    seen = []
    for c, w in enumerate(chain.weights):
        y = toxic if c == 3 else (kind == c).astype(np.float32)
        assert w == pytest.approx(toxicity.fit_linear(x, seen, y), abs=1e-5)
        out = np.zeros(len(toxic), np.float32)
        for row in range(len(toxic)):
            if row < toxicity.FOLDS:
                others = [r for r in range(len(toxic)) if r % toxicity.FOLDS != row]
                unseen = toxicity.fit_linear(x[others], [s[others] for s in seen], y[others])
                for r in range(row, len(toxic), toxicity.FOLDS):
                    out[r] = toxicity.predict(unseen, x[[r]], [s[[r]] for s in seen])[0]
        seen.append(out)
    p = [0.0] * 4
    for c, w in enumerate(chain.weights):
        z = w[-1] + float(x[7] @ w[: x.shape[1]]) + sum(float(w[x.shape[1] + k]) * p[k] for k in range(c))
        p[c] = 1 / (1 + np.exp(-z))
    assert chain.score(x)[7] == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("seed", range(8))
def test_clusters_are_kinds(seed):
    """Rows of a group share a kind, and every row is nearest to its own kind's mean direction."""
    first, slots, toxic = made_texts(seed=seed)
    hit = [k for k in range(len(toxic)) if toxic[k] and (slots[first[k] : first[k + 1]] < 100).any()]
    x = np.array([[float(s in slots[first[k] : first[k + 1]]) for s in (10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 32, 33)] for k in hit], np.float32)
    own, group = toxicity.clusters(x, 3), np.argmax(x.reshape(len(hit), 3, 4).sum(2), axis=1)
    assert sum(len(set(own[group == g].tolist())) for g in range(3)) == 3 and len(set(own.tolist())) == 3
    with_nothing = np.concatenate([np.zeros((5, 12), np.float32), x])
    assert (toxicity.clusters(with_nothing, 3)[:5] == -1).all() and (toxicity.clusters(with_nothing, 3)[5:] == own).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_kinds_of_the_tables(spark, sf):
    """Every kind has several rows and is another category than `toxic`, in the labels and in what the chain predicts."""
    base = SF.replace("sf0.001", sf)
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.labelled_sample(docs, labels, "toxic", toxicity.SAMPLE).orderBy("_id").collect()
    first, slots, _ = toxicity.word_and_prefix_slots(Text(pa.array([r._text for r in rows])), toxicity.WIDTH)
    toxic = np.array([r._label > 0 for r in rows], np.float32)
    chain = toxicity.fit_chain(first, slots, toxic)
    x = chain.inputs(first, slots)
    kind = toxicity.clusters(x[toxic > 0], 3)
    counts = np.bincount(kind[kind >= 0], minlength=3)
    assert counts.min() >= 3 and counts.max() <= 0.9 * toxic.sum()
    said = chain.score(x) >= 0.5
    assert all(said[:, k].sum() >= 3 and (said[:, k] != said[:, 3]).sum() >= 3 for k in range(3))


def test_chain_is_no_worse_than_its_last_model_alone(spark):
    base = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = docs.join(labels, "doc_id").where("toxic is not null").orderBy("doc_id").select("doc_id", "text", "toxic", F.crc32(F.col("doc_id").cast("string")).alias("crc")).collect()
    train, test = [r for r in rows if r.crc % 3 != 1], [r for r in rows if r.crc % 3 == 1]
    of = lambda some: toxicity.word_and_prefix_slots(Text(pa.array([r.text for r in some])), toxicity.WIDTH)[:2]
    label = lambda some: np.array([r.toxic > 0 for r in some], np.float32)
    chain = toxicity.fit_chain(*of(train), label(train))
    alone = toxicity.fit_linear(chain.inputs(*of(train)), [], label(train))
    x = chain.inputs(*of(test))
    assert auc(label(test), chain.score(x)[:, -1]) >= auc(label(test), toxicity.predict(alone, x, [])) - 0.005


# -- pipeline ------------------------------------------------------------------------------------------------
def test_pipeline(spark, texts):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus.STAGES)
    good = stage["quality_classifier"](spark, docs, SF)
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5}
    single = stage["ngram_jaccard_join"](spark, good, SF)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {c for c, _ in links_of(kept).values()}
    masked = stage["pii"](spark, single, SF)
    assert masked.columns == docs.columns and masked.where("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0 and masked.count() == single.count()
    last = corpus.run(spark, SF)
    assert set(docs.columns) < set(last.columns) and last.where("not round_trip").count() == 0 and 0 < last.count() <= single.count()


def test_pipeline_edges(spark, odd, nothing):
    corpus = pytest.importorskip("corpus_pipeline")
    for d in (odd, nothing):
        for _, stage in corpus.STAGES:
            d = stage(spark, d, SF)
        assert d.count() <= odd.count()
