"""Streams with timers, counted late rows and partitioned upserts; the older streams that had no test."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans.stream_queries import as_stream, run_to_end
from tidemark.session import shared
from tidemark.streaming import live

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def since(t):
    return round(t - START.replace(tzinfo=dt.timezone.utc).timestamp(), 3)


@pytest.fixture
def timers(spark):
    before = spark.conf.get(live.STATE_STORE[0])
    spark.conf.set(*live.STATE_STORE)
    yield
    spark.conf.set(live.STATE_STORE[0], before)


def debounced_plainly(samples, hold=1.0, release=0.3):
    """Changes of one scan's flag by a loop over sorted (t, ok); the samples' time goes on after them."""
    out, begun, last_ok, shown = [], None, None, False
    for t, ok in [*sorted(samples), (10**6, False)]:
        if begun is not None and t - last_ok >= release - 1e-9:
            out += [(round(last_ok + release, 3), False)] if shown else []
            begun, shown = None, False
        if ok:
            begun, last_ok = t if begun is None else begun, t
            if not shown and t - begun >= hold - 1e-9:
                shown = True
                out.append((t, True))
    return out


def test_debounce_releases_when_samples_stop(spark, timers):
    scans = {
        1: [(k / 10, True) for k in range(31)],  # stops while it is ok
        2: [(k / 10, k % 7 < 5) for k in range(80)],  # dips of 0.2 s
        3: [(k / 10, k < 20 or k > 60) for k in range(90)], 4: [(k / 10, k % 2 == 0 and k < 9) for k in range(40)], 9: [(k / 10, False) for k in range(200)],
    }
    rows = [(s, at(t), ok) for s, samples in scans.items() for t, ok in samples]
    got = run_to_end(spark, live.debounced(as_stream(spark, spark.createDataFrame(rows, "scan bigint, ts timestamp, ok boolean").repartition(3)))).collect()
    for s, samples in scans.items():
        assert sorted((since(r.t), r.aligned) for r in got if r.scan == s) == debounced_plainly(samples), s
    assert (3.3, False) in [(since(r.t), r.aligned) for r in got if r.scan == 1]


def test_debounce_over_batches_out_of_order(spark, timers):
    """Samples that come in later batches, within the allowed lateness, change nothing."""
    rows = [(1, at(k / 10), k < 25) for k in range(60)] + [(2, at(k / 10), False) for k in range(200)]
    path = f"{shared(spark)}/in"
    d = spark.createDataFrame(rows, "scan bigint, ts timestamp, ok boolean")
    early = F.col("ts") < F.lit(at(2))
    mixed = (F.unix_millis("ts") / 100).cast("long") % 3 == 0
    for k, part in enumerate((d.where(early & ~mixed), d.where(early & mixed), d.where(~early))):
        part.coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    got = run_to_end(spark, live.debounced(stream, late="5 seconds"))
    assert sorted((since(r.t), r.aligned) for r in got.where("scan = 1").collect()) == [(1.0, True), (2.7, False)]


def in_batches(spark, frames):
    """A stream with one batch a frame."""
    path = f"{shared(spark)}/in"
    for k, d in enumerate(frames):
        d.coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{f}", (1_700_000_000 + 10 * k,) * 2)  # files are taken in order of their age
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_late_rows_are_counted(spark):
    """Emitted and late rows are all that were sent, in each batch and in sum."""
    schema = "k bigint, ts timestamp"
    batches = [[0, 100, 50], [200, 95, 101, 190], [150, 139, 140, 141], [400], [340, 341, 200]]
    frames = [spark.createDataFrame([(10 * n + k, at(t)) for k, t in enumerate(b)], schema) for n, b in enumerate(batches)]
    counts = live.Counts()
    spark.streams.addListener(counts)
    path = shared(spark)
    try:
        live.with_late(in_batches(spark, frames), f"{path}/out", f"{path}/state", late=60.0).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counts)
    in_time, late = (spark.read.schema(schema + ", _batch bigint").parquet(f"{path}/out/{x}").collect() for x in ("in_time", "late"))
    newest, want = None, []
    for n, b in enumerate(batches):
        want += [10 * n + k for k, t in enumerate(b) if newest is not None and t <= newest - 60]
        newest = max([*b, *([newest] if newest is not None else [])])
    assert sorted(r.k for r in late) == sorted(want) and len(want) == 4
    sent = sum(map(len, batches))
    assert len(in_time) + len(late) == sent and sorted(r.k for r in [*in_time, *late]) == sorted(10 * n + k for n, b in enumerate(batches) for k in range(len(b)))
    assert counts.totals["late_rows"]["sent"] == sent
    clock = {r._batch: r for r in spark.read.parquet(f"{path}/out/clock").collect()}
    assert {n: (r.sent, r.late) for n, r in clock.items()} == {n: (len(b), sum(r._batch == n for r in late)) for n, b in enumerate(batches)}


def files_of(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_touches_only_its_partitions(spark):
    """Keys keep their last row; a batch leaves the files of other partitions alone; a replay changes nothing."""
    path = shared(spark)
    table = f"{path}/table"
    schema = "k bigint, seq int, v string"
    first = spark.createDataFrame([(k, 1, "a") for k in range(40)], schema)
    source = in_batches(spark, [first])
    run = lambda state: live.upsert_batches(source, table, ["k"], "seq", f"{path}/{state}", parts=8).awaitTermination()
    run("state")
    assert spark.read.parquet(table).count() == 40
    before = files_of(table)
    second = spark.createDataFrame([(3, 2, "b"), (3, 1, "older"), (100, 1, "new"), (5, 1, "tie")], schema)
    second.coalesce(1).write.parquet(f"{path}/two")
    more = spark.readStream.schema(schema).parquet(f"{path}/two")

    def again(number):
        """The second rows as batch 1 (and that batch again), through the same writer."""
        holder = {}

        class Catch:
            def foreachBatch(self, f):
                holder["f"] = f
                return self

            option = trigger = lambda self, *a, **k: self

            def start(self):
                return None

        class Fake:
            writeStream = Catch()

        live.upsert_batches(Fake(), table, ["k"], "seq", "", parts=8)
        holder["f"](spark.read.schema(schema).parquet(f"{path}/two"), number)

    again(1)
    rows = lambda: sorted((r.k, r.seq, r.v) for r in spark.read.parquet(table).collect())
    want = sorted([(k, 1, "a") for k in range(40) if k not in (3, 5)] + [(3, 2, "b"), (5, 1, "tie"), (100, 1, "new")])
    assert rows() == want and more.isStreaming
    touched = {r[0] for r in spark.createDataFrame([(3,), (100,), (5,)], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    kept = {f for f in before if int(f.split("_part=")[1].split("/")[0]) not in touched}
    assert kept and kept < files_of(table) and len(touched) < 8
    again(1)
    assert rows() == want
    run("state")  # nothing new in the source: nothing happens
    assert rows() == want


def test_repeated_frames_and_medians(spark):
    frames = as_stream(spark, spark.createDataFrame([(1, at(t), v) for t, v in ((1, 5.0), (1, 5.0), (2, 7.0), (3, 90.0), (2, 7.0))], "scan bigint, ts timestamp, v double"))
    assert sorted((since(r.ts.replace(tzinfo=dt.timezone.utc).timestamp()), r.v) for r in run_to_end(spark, live.distinct_frames(frames, ["scan"])).collect()) == [(1.0, 5.0), (2.0, 7.0), (3.0, 90.0)]
    values = spark.createDataFrame([(1, at(t), float(t)) for t in range(30)], "scan bigint, ts timestamp, v double")
    got = {since(r.end.replace(tzinfo=dt.timezone.utc).timestamp()): (r.n, r.median) for r in run_to_end(spark, live.sliding_median(as_stream(spark, values), ["scan"], "v")).collect()}
    assert got[10.0] == (10, 4.5) and got[20.0] == (10, 14.5) and 2.0 not in got and got[3.0] == (3, 1.0)


def test_debounce_query(spark):
    """The flags of the events by a plain loop, up to the watermark at the newest event."""
    from collections import defaultdict

    from tests.test_oracle import SF
    from tidemark import plans

    got = defaultdict(list)
    for r in plans.QUERIES["stream_debounce"](spark, SF).collect():
        got[r.scan].append((round(r.t, 2), r.aligned))
    events = defaultdict(list)
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("t"), (F.col("value") > 50).alias("ok")).collect()
    newest = max(r.t for r in rows)
    for r in rows:
        events[r.user_id].append((r.t, r.ok))
    for s, samples in events.items():
        want = [(round(t, 2), up) for t, up in debounced_plainly([x for x in samples if x[0] < newest], 21600.0, 21600.0) if t <= newest]
        assert sorted(got[s]) == sorted(want), s
    assert sum(map(len, got.values())) > 5


def test_debounce_sets_a_timer_a_batch():
    """A hundred samples of a key need one timer, and so does what is left once the watermark has passed some of them."""
    import pandas as pd

    class State:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held if self.held is not None else []
        put = update = lambda self, v: setattr(self, "held", v)
        appendList = lambda self, v: setattr(self, "held", [*(self.held or []), *v])
        clear = lambda self: setattr(self, "held", None)

    class Handle:
        def __init__(self):
            self.timers = []

        getValueState = getListState = lambda self, *_: State()
        registerTimer = lambda self, at: self.timers.append(at)

    class Now:
        getCurrentWatermarkInMs = lambda self: int(at(5).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    handle, flag = Handle(), live.Debounce("scan", 1.0, 0.3)
    flag.init(handle)
    list(flag.handleInputRows((1,), iter([pd.DataFrame({"ts": [at(k / 10) for k in range(100)], "ok": [True] * 100})]), None))
    assert [since(t / 1000) for t in handle.timers] == [0.001]
    got = [r for f in flag.handleExpiredTimer((1,), Now(), None) for r in f.itertuples(index=False)]
    assert [(since(r.t), r.aligned) for r in got] == [(1.0, True)]
    assert [since(t / 1000) for t in handle.timers] == [0.001, 5.001] and len(flag.waiting.get()) == 50
