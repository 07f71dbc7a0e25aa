"""N-gram Jaccard join by chosen paths: split sets recursively on sampled shared tokens, brute-force small buckets, repeat.

A document's set is its distinct runs of five words. Equal sets make one class; classes are joined. Each class is
embedded as 128 min-hash tokens (place, value), so that two sets share a token with the probability of their
similarity. A run samples one token and splits all classes by it; a bucket above `limit` is split again on two
further sampled tokens each, and again, up to three levels; buckets are compared by brute force. Runs are
repeated until a pair at the threshold is met with the probability `recall`.

Brute force within a bucket compares the embeddings only, loosely, and yields a spanning forest, not all pairs. The
forests' components are supersets of the true ones; their sets are then compared exactly, every pair of a component,
in blocks of at most `limit` classes by `limit`, which yields the number of links of each class and again only a
spanning forest. Blocks of a large component hold sets of like sizes and meet only where the sizes allow a link. So
links are exact within each component that the paths connected, and no group is expanded.

Handling of edge cases: null and wordless texts have no shingles, are similar to nothing and stay alone; a text of one
to four words has one shingle, all its words; a very long text is handled alone, whole; repeated rows and equal texts
share a class; rows that share an id are documents of their own, each judged by its own text; rows without an id are
compared like all others but name no class: class_id is null only where no document of the class has an id; an empty
table gives an empty result; further columns are dropped by `jaccard_classes`, whatever their names, and kept by
`drop_near_copies`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, stash
from tidemark.llm.components import components
from tidemark.llm.textbytes import chunks, mix, shingles

TOKENS = 128  # of an embedding
LEVELS, BRANCHES = 3, 2


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold shares some first token with the probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold))


def embed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingles, their row offsets, embeddings as uint16[rows, TOKENS]); a row without shingles has zeros."""
    factors = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
    for row, text in chunks(column):
        out, first = shingles(text)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        sketch = np.zeros((len(text), TOKENS), np.uint16)
        at = first[:-1][full]
        if len(full):
            for k in range(TOKENS):
                low = np.minimum.reduceat(out * factors[k], at)
                sketch[full, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
        yield row, out, first, sketch


def _sketched(batches: Iterator[pa.RecordBatch], runs: int) -> Iterator[pa.RecordBatch]:
    """(id, row, text) -> (id, row, set_key, size, sketch, paths): paths holds each run's bucket keys, level by level."""
    picks = _picks(runs)
    for batch in batches:
        for row, out, first, sketch in embed(batch.column(2)):
            n = len(first) - 1
            sizes = np.diff(first)
            keys = _paths(sketch, picks)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k).slice(row, n) for k in (0, 1)],
                    _set_keys(out, first),
                    pa.array(sizes.astype(np.int32)),
                    _binary(sketch),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
                ],
                names=["_id", "_row", "_set", "_size", "_sketch", "_paths"],
            )


def _set_keys(out: np.ndarray, first: np.ndarray) -> pa.Array:
    """24 bytes that tell sets apart: two sums of their hashes, and their number."""
    sums = np.zeros((len(first) - 1, 3), np.uint64)
    sums[:, 2] = np.diff(first)
    full = np.flatnonzero(sums[:, 2])
    if len(full):
        sums[full, 0] = np.add.reduceat(mix(out), first[:-1][full])
        sums[full, 1] = np.add.reduceat(mix(out ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full])
    return _binary(sums)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    offsets = np.arange(0, width * len(rows) + 1, width, dtype=np.int32) if len(rows) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _picks(runs: int) -> list[list[tuple[int, int]]]:
    """For each run, (parent, token place) of its nodes, level by level: 1, 2 and 4 nodes."""
    out = []
    for run in range(runs):
        order = np.argsort(mix(np.arange(TOKENS, dtype=np.uint64) + np.uint64(1000 * (run + 1))))
        nodes, used, parents = [], 0, [-1]
        for level in range(LEVELS):
            own = []
            for parent in parents:
                for _ in range(1 if level == 0 else BRANCHES):
                    own.append(len(nodes))
                    nodes.append((parent, int(order[used % TOKENS])))
                    used += 1
            parents = own
        out.append(nodes)
    return out


def _paths(sketch: np.ndarray, picks: list[list[tuple[int, int]]]) -> np.ndarray:
    cols = []
    for run, nodes in enumerate(picks):
        own: list[np.ndarray] = []
        for k, (parent, place) in enumerate(nodes):
            above = own[parent] if parent >= 0 else np.full(len(sketch), run + 1, np.uint64)
            own.append(mix(above * np.uint64(0x100000001B3) + sketch[:, place].astype(np.uint64) + np.uint64(k << 20)))
        cols += own
    return np.stack(cols, axis=1) if cols else np.zeros((len(sketch), 0), np.uint64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each key (column 0) of batches sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if held and (k > 0 or held[-1].column(0)[0].as_py() != keys[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _bucket_forests(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(bucket, rep, size, sketch) sorted by bucket -> (a, b): edges of a spanning forest of the loosely similar."""
    a_out: list[int] = []
    b_out: list[int] = []
    for group in _groups(batches):
        n = group.num_rows
        if n > 1:
            reps = group.column(1).to_numpy()
            sizes = group.column(2).to_numpy().astype(np.int64)
            sketch = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint16).reshape(n, TOKENS)
            forest, left = Forest(n), np.arange(n)
            for i in range(n - 1):
                later = left[left > i]
                same = (sketch[later] == sketch[i]).sum(1) >= least * TOKENS
                near = later[same & (np.minimum(sizes[later], sizes[i]) >= (least - 0.05) * np.maximum(sizes[later], sizes[i]))]
                for j in near.tolist():
                    if forest.join(i, j):
                        a_out.append(int(reps[i]))
                        b_out.append(int(reps[j]))
        if len(a_out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            a_out, b_out = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, ..., set_key, text) -> (rep, ..., shingle hashes as binary) of the rows whose text has that set."""
    for batch in batches:
        n = batch.num_columns
        for row, text in chunks(batch.column(n - 1)):
            out, first = shingles(text)
            sets = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
            right = pc.equal(_set_keys(out, first), batch.column(n - 2).slice(row, len(text)))
            whole = pa.RecordBatch.from_arrays([c.slice(row, len(text)) for c in batch.columns[: n - 2]] + [sets], names=batch.schema.names[: n - 2] + ["_shingles"])
            yield whole.filter(right)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, set_key, text) of the rows with shingles."""
    for batch in batches:
        for row, text in chunks(batch.column(1)):
            out, first = shingles(text)
            whole = pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(text)), _set_keys(out, first), batch.column(1).slice(row, len(text))], names=["_id", "_set", "_text"])
            yield whole.filter(pa.array(np.diff(first) > 0))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of the incidence matrix, a few thousand columns at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    step = max(256, (1 << 22) // max(n, 1))
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        block = np.zeros((n, min(step, int(shared.sum()) - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _exact(batches: Iterator[pa.RecordBatch], top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    """(key, rep, copies, block, first, second, shingles) sorted by key -> (a, b, links).

    Rows with b null carry the linked documents of class a in this pair of blocks, the others are forest edges.
    Similarity is compared as a fraction, top / bottom.
    """
    for group in _groups(batches):
        n = group.num_rows
        if n < 2:
            continue
        reps, copies = group.column(1).to_numpy(), group.column(2).to_numpy()
        block, first, second = (group.column(k).to_numpy() for k in (3, 4, 5))
        sets = [np.frombuffer(x, np.uint64) for x in group.column(6).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _overlaps(sets)
        linked = bottom * common >= top * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        if first[0] != second[0]:  # pairs within a block are compared where that block meets itself
            linked &= block[:, None] != block[None, :]
        links = (linked * copies[None, :]).sum(1)
        forest = Forest(n)
        a_out, b_out = [], []
        for i in range(n):
            for j in np.flatnonzero(linked[i, i + 1 :]).tolist():
                if forest.join(i, i + 1 + j):
                    a_out.append(int(reps[i]))
                    b_out.append(int(reps[i + 1 + j]))
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a_out + reps[some].tolist(), pa.int64()),
                pa.array(b_out + [None] * len(some), pa.int64()),
                pa.array([0] * len(a_out) + links[some].tolist(), pa.int64()),
            ],
            names=["a", "b", "links"],
        )


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """-> (id_col, class_id, n_copies, n_links): one row per input row.

    class_id is the smallest id, nulls aside, of the documents connected by links (similarity of at least the threshold),
    n_copies the number of documents with the very same set, n_links the number of other documents linked to this one.
    Options are those of `judged_rows`.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    return judged_rows(rows, **options).select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"), F.col("_copies").alias("n_copies"), F.col("_links").alias("n_links"))


def judged_rows(rows: DataFrame, threshold: float = 0.8, recall: float = 0.999, limit: int = 500, slack: float = 0.12) -> DataFrame:
    """Rows (_id, _row, _text) -> (_id, _row, _class, _keeper, _copies, _links), one row per input row.

    _class and _keeper are the id and the row number of the class's first document: of the least id, nulls last, and
    of these of the least row number.
    """
    runs = runs_for(recall, threshold)
    top, bottom = (round(threshold * 1000), 1000)
    low = rows.agg(F.min("_id")).first()[0] or 0
    rows = rows.withColumn("_id", F.coalesce("_id", F.lit(low - 1)))
    known = lambda c: F.when(c != low - 1, c)
    sketched = stash(rows.select("_id", "_row", "_text").mapInArrow(lambda b: _sketched(b, runs), "_id bigint, _row bigint, _set binary, _size int, _sketch binary, _paths array<bigint>"))

    first = F.min(F.struct((F.col("_id") == low - 1).alias("unnamed"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first")
    whole = sketched.where("_size > 0").groupBy("_set").agg(first, F.count("*").alias("_copies"), F.any_value("_size").alias("_size"), F.any_value("_sketch").alias("_sketch"), F.any_value("_paths").alias("_paths"))
    classes = stash(whole.withColumn("_rep", F.monotonically_increasing_id()))

    dealt = _block_pairs(_buckets(classes.select("_rep", "_paths"), runs, limit))
    dealt = dealt.select(F.xxhash64("_key", "_first", "_second").alias("_k"), "_rep").join(classes.select("_rep", "_size", "_sketch"), "_rep").select("_k", "_rep", "_size", "_sketch")
    edges = dealt.repartition("_k").sortWithinPartitions("_k").mapInArrow(lambda b: _bucket_forests(b, threshold - slack), "a bigint, b bigint")
    loose = components(edges)

    # exact, within each loose component
    members = _banded(loose.withColumnsRenamed({"node": "_rep", "component": "_key"}).join(classes.select("_rep", F.col("_first.id").alias("_id"), "_set", "_size", "_copies"), "_rep"), threshold, limit)
    # by the set too: many rows may share an id or have none
    texts = rows.select("_id", "_text").mapInArrow(_keyed, "_id bigint, _set binary, _text string").join(small(members), ["_id", "_set"]).select("_rep", "_key", "_copies", "_band", "_bands", "_set", "_text")
    sets = texts.mapInArrow(_with_sets, "_rep bigint, _key bigint, _copies bigint, _band int, _bands map<int,int>, _shingles binary").groupBy("_rep").agg(*[F.any_value(c).alias(c) for c in ("_key", "_copies", "_band", "_bands", "_shingles")])
    pairs = _band_pairs(stash(sets))
    pairs = pairs.select(F.xxhash64("_key", "_first", "_second").alias("_k"), "_rep", "_copies", "_block", "_first", "_second", "_shingles")
    found = stash(pairs.repartition("_k").sortWithinPartitions("_k").mapInArrow(lambda b: _exact(b, top, bottom), "a bigint, b bigint, links bigint"))
    linked = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "_rep")
    links = found.where("b is null").groupBy(F.col("a").alias("_rep")).agg(F.sum("links").alias("_links"))

    own = classes.select("_set", "_rep", "_first", "_copies")
    least = linked.join(own, "_rep").groupBy("component").agg(F.min("_first").alias("_of_all"))
    per_class = own.join(linked.join(least, "component").select("_rep", "_of_all"), "_rep", "left").join(links, "_rep", "left")
    per_class = stash(per_class.select("_set", F.coalesce("_of_all", "_first").alias("_of_all"), "_copies", F.coalesce("_links", F.lit(0)).alias("_links")))
    out = sketched.select("_id", "_row", "_size", "_set").join(per_class, "_set", "left")
    lone = F.col("_size") == 0
    return out.select(
        known(F.col("_id")).alias("_id"), "_row", known(F.when(lone, F.col("_id")).otherwise(F.col("_of_all.id"))).alias("_class"), F.when(lone, F.col("_row")).otherwise(F.col("_of_all.row")).alias("_keeper"),
        F.when(lone, 1).otherwise(F.col("_copies")).cast("bigint").alias("_copies"), F.when(lone, 0).otherwise(F.col("_links") + F.col("_copies") - 1).cast("bigint").alias("_links"),
    )


def _buckets(classes: DataFrame, runs: int, limit: int) -> DataFrame:
    """(_rep, _paths) -> (_key, _rep, _blocks) of the buckets with two classes or more.

    A node's bucket is used unless it is above the limit and not of the last level, where it gives way to its
    children. A crowded bucket's child is no larger than it, so a node is reached just if its parent is crowded.
    Buckets of the last level above the limit are divided into blocks.
    """
    nodes = sum(BRANCHES**k for k in range(LEVELS))
    leaves = nodes - BRANCHES ** (LEVELS - 1)
    inner = F.array(*[F.struct(F.lit(r * nodes + k).alias("node"), F.get("_paths", F.lit(r * nodes + k)).alias("key")) for r in range(runs) for k in range(leaves)])
    keys = classes.select("_rep", F.inline(inner))
    crowded = keys.groupBy("key").count().where(F.col("count") > limit).select("key")
    over = keys.join(crowded, "key").groupBy("_rep").agg(F.collect_set("node").alias("_over"))
    held = classes.join(over, "_rep", "left").withColumn("_over", F.coalesce("_over", F.array().cast("array<int>")))

    def used(k: int) -> Column:
        run, at = divmod(k, nodes)
        gives_way = F.array_contains("_over", k) if at < leaves else F.lit(False)
        reached = F.array_contains("_over", run * nodes + (at - 1) // BRANCHES) if at else F.lit(True)
        return F.when(reached & ~gives_way, F.get("_paths", F.lit(k)))

    found = held.select("_rep", F.explode(F.filter(F.array(*[used(k) for k in range(runs * nodes)]), lambda x: x.isNotNull())).alias("_key"))
    counts = found.groupBy("_key").count().where("count > 1").select("_key", F.ceil(F.col("count") / limit).cast("int").alias("_blocks"))
    return found.join(counts, "_key")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each row (_key, _rep or _id, _blocks, ...) once for each pair of its group's blocks that holds its own."""
    own = rows.withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumn("_first", F.least("_block", "_other")).withColumn("_second", F.greatest("_block", "_other")).drop("_other")


def _banded(members: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Members (_rep, _key, _size, ...), written, with _band and _bands: the number of blocks of each band of their component.

    Bands are of sizes within a factor of 1 / threshold, so linked sets are of the same band or of neighbouring ones and
    a large component's other blocks need not meet. A component of at most `limit` classes is one block.
    """
    members = stash(members.withColumn("_own_band", F.floor(F.ln("_size") / (-math.log(threshold) * (1 + 1e-9))).cast("int")))
    counts = members.groupBy("_key", "_own_band").agg(F.count("*").alias("_n")).groupBy("_key")
    blocks = F.struct(F.col("_own_band").alias("key"), F.ceil(F.col("_n") / limit).cast("int").alias("value"))
    crowded = counts.agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(blocks)).alias("_bands")).where(F.col("_all") > limit).select("_key", "_bands")
    out = members.join(small(crowded), "_key", "left")
    one = F.create_map(F.lit(0), F.lit(1))
    return out.select(*[c for c in members.columns if c != "_own_band"], F.when(F.col("_bands").isNull(), 0).otherwise(F.col("_own_band")).alias("_band"), F.coalesce("_bands", one).alias("_bands"))


def _band_pairs(rows: DataFrame) -> DataFrame:
    """Each row (_key, _rep, _band, _bands, ...) once for each pair of blocks of its own or neighbouring bands that holds its own."""
    wide = 1 << 32  # blocks of a band, numbered from band * wide
    blocks = lambda band: F.coalesce(F.col("_bands")[band], F.lit(0))
    own = rows.withColumn("_block", F.col("_band").cast("bigint") * wide + F.pmod(F.xxhash64("_rep"), blocks(F.col("_band"))))

    def beside(shift: int) -> Column:
        band = F.col("_band") + shift
        n = blocks(band)
        other = lambda j: band.cast("bigint") * wide + j
        some = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least("_block", other(j)).alias("first"), F.greatest("_block", other(j)).alias("second")))
        return F.when(n > 0, some).otherwise(F.array().cast("array<struct<first:bigint,second:bigint>>"))

    met = own.withColumn("_met", F.explode(F.concat(beside(-1), beside(0), beside(1))))
    return met.withColumns({"_first": F.col("_met.first"), "_second": F.col("_met.second")}).drop("_met", "_band", "_bands")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest id, of equal ids the row written first; all columns stay.

    Rows are told apart by a written row number, not by their id: a row goes only if its own text is of the class.
    Rows without an id stay.
    """
    key = "_row" + "_" * max(map(len, docs.columns))  # clashes with no column
    rows = stash(docs.withColumn(key, F.monotonically_increasing_id()))
    judged = judged_rows(rows.select(F.col(id_col).cast("bigint").alias("_id"), F.col(key).alias("_row"), F.col(text_col).alias("_text")), **options)
    gone = judged.where(F.col("_id").isNotNull() & (F.col("_row") != F.col("_keeper"))).select(F.col("_row").alias(key))
    return rows.join(gone, key, "left_anti").drop(key)
