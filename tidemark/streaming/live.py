"""Structured Streaming forms of the live operators.

State is per subject or scan, bounded (a few numbers, a short ring), and watermarks close what is complete. Rows later
than the watermark are dropped by Spark's operators; `with_late` sets them apart first, so that none goes uncounted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import written

#: transformWithState keeps its state in this store; set it on the session before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def distinct_frames(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Frames without repeats of (keys, ts), however they are ordered within the allowed lateness."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def fold_days(stream: DataFrame, subject: str = "subject_id", ts: str = "ts", carried: str = "carried", late: str = "1 hour", shift: str = "0 hours", min_windows: int = 10) -> DataFrame:
    """Tumbling days (shifted, say 12 hours for noon to noon) -> subject, day, n_windows, n_carried, carried_frac, valid.

    A day is emitted once the watermark has passed it.
    """
    days = stream.withWatermark(ts, late).groupBy(subject, F.window(ts, "1 day", startTime=shift)).agg(F.count("*").alias("n_windows"), F.count_if(carried).alias("n_carried"))
    return days.select(subject, F.to_date("window.end" if shift != "0 hours" else "window.start").alias("day"), "n_windows", "n_carried", (F.col("n_carried") / F.col("n_windows")).alias("carried_frac"), (F.col("n_windows") >= min_windows).alias("valid"))


def sessions(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Stretches without a gap -> keys, start, end, n."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(*keys, w).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding_median(stream: DataFrame, keys: list[str], value: str, ts: str = "ts", length: str = "10 seconds", step: str = "1 second", late: str = "2 seconds", min_n: int = 3) -> DataFrame:
    """Every step, the median of the last stretch -> keys, start, end, n, median; stretches with fewer than min_n rows are left out."""
    w = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, length, step)).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))
    return w.where(F.col("n") >= min_n).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "median")


def alerts(days: DataFrame, limit: float = 0.5, k: int = 3, max_gap: int = 2, refractory: int = 7, subject: str = "subject_id", kind: str = "bigint") -> DataFrame:
    """A stream of closed days (subject, day, carried_frac, valid, held) -> subject, day, run_len, alert.

    State per subject: last day, run, last alert. Days of one micro-batch are taken in order; a day that is not after
    the last one seen comes too late and is dropped. Equals operators.alerts over the same days.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, fired = state.get if state.exists else (-1, 0, -(10**6))
        rows = pd.concat(list(frames)).sort_values("day")
        numbers = (pd.to_datetime(rows["day"]) - pd.Timestamp("1970-01-01")).dt.days
        out = []
        for day, n, frac, valid, held in zip(rows["day"], numbers, rows["carried_frac"], rows["valid"], rows["held"], strict=True):
            if n <= last:
                continue
            if last >= 0 and n - last > max_gap:
                run = 0
            last, shown, alert = n, 0, False
            if valid and not held:
                run = run + 1 if frac is not None and frac >= limit else 0
                shown = run
                alert = bool(run >= k and n - fired >= refractory)
                fired = n if alert else fired
            out.append((key[0], day, shown, alert))
        state.update((int(last), int(run), int(fired)))
        yield pd.DataFrame(out, columns=[subject, "day", "run_len", "alert"])

    return days.groupBy(subject).applyInPandasWithState(step, f"{subject} {kind}, day date, run_len bigint, alert boolean", "last bigint, run bigint, fired bigint", "append", GroupStateTimeout.NoTimeout)


def early_stop(estimates: DataFrame, n: int = 3, within: float = 2.0, snr: float = 3.0, seconds: float = 10.0, scan: str = "scan", kind: str = "bigint") -> DataFrame:
    """Estimates (scan, t, bpm, snr and perhaps passed) -> one row (scan, t, bpm) for each scan: the first time, not before
    `seconds`, that its last n lie within `within` of the latest, that one is clear, and the scan so far passes its gates.

    State: the last n estimates and whether the scan has stopped. An unknown estimate agrees with none.
    """
    gated = "passed" in estimates.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, done = state.get if state.exists else ([], False)
        ring = list(ring)
        out = []
        rows = pd.concat(list(frames)).sort_values("t")
        for t, bpm, q, ok in zip(rows["t"], rows["bpm"], rows["snr"], rows["passed"] if gated else [True] * len(rows), strict=True):
            if done:
                break
            ring = [*ring, float("nan") if bpm is None else float(bpm)][-n:]
            near = all(abs(x - ring[-1]) <= within for x in ring)  # not so for an unknown one
            if len(ring) == n and near and q is not None and q >= snr and t >= seconds and not pd.isna(ok) and bool(ok):
                out.append((key[0], float(t), float(bpm)))
                done = True
        state.update((ring, bool(done)))
        yield pd.DataFrame(out, columns=[scan, "t", "bpm"])

    return estimates.groupBy(scan).applyInPandasWithState(step, f"{scan} {kind}, t double, bpm double", "ring array<double>, done boolean", "append", GroupStateTimeout.NoTimeout)


def preview(samples: DataFrame, estimate: Callable[[np.ndarray, np.ndarray], tuple[float, float]], window: float = 10.0, least: float = 10.0, gap: float = 0.25, longest: float = 1.0, covered: float = 0.8, fresh: float = 1.5, forget: float = 60.0, late: str = "0 seconds", scan: str = "scan", kind: str = "bigint") -> DataFrame:
    """Camera samples (scan, ts, rgb) -> (scan, t, bpm, snr) after each batch, t in epoch seconds of the newest sample, from its last `window` seconds.

    No rate is shown (NULL) before `least` valid seconds, for a window with a hole above `longest` or less covered than
    `covered`, and once the watermark is `fresh` seconds past the newest sample. Steps above `gap` are holes. A sample not after
    the newest one seen is dropped. State: the window's samples and the valid seconds, until `forget` seconds after the rate went blank.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, colours, valid, blank = state.get if state.exists else ([], [], 0.0, False)
        if state.hasTimedOut:
            if blank:
                state.remove()
                return
            state.update((times, colours, valid, True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(forget * 1000))
            yield pd.DataFrame([(key[0], times[-1], None, None)], columns=[scan, "t", "bpm", "snr"])
            return
        new = pd.concat(list(frames)).sort_values("ts")
        t = np.array([v.timestamp() for v in new["ts"]])
        newer = t > (times[-1] if len(times) else -np.inf)
        t, first = np.unique(t[newer], return_index=True)
        c = np.array([list(v) for v in new["rgb"]], float).reshape(len(new), -1)[newer][first]
        steps = np.diff(np.concatenate([list(times)[-1:], t]))
        valid += float(steps[steps <= gap].sum())
        t = np.concatenate([np.array(times, float), t])
        c = np.concatenate([np.array([list(v) for v in colours], float).reshape(-1, c.shape[1]), c])
        c, t = c[t >= t[-1] - window], t[t >= t[-1] - window]
        bpm = snr = None
        d = np.diff(t)
        if valid >= least - 0.1 and len(t) > 1 and d.max() <= longest and d[d <= gap].sum() >= covered * (t[-1] - t[0]):
            bpm, snr = estimate(t - t[0], c)
        state.update((t.tolist(), c.tolist(), valid, False))
        state.setTimeoutTimestamp(max(int((t[-1] + fresh) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], float(t[-1]), bpm, snr)], columns=[scan, "t", "bpm", "snr"])

    watched = samples.withWatermark("ts", late)
    return watched.groupBy(scan).applyInPandasWithState(step, f"{scan} {kind}, t double, bpm double, snr double", "t array<double>, rgb array<array<double>>, valid double, blank boolean", "append", GroupStateTimeout.EventTimeTimeout)


def steady(stream: DataFrame, hold: float = 1.0, release: float = 0.3, scan: str = "scan", kind: str = "bigint") -> DataFrame:
    """Alignment flags (scan, t, ok) -> (scan, t, aligned) at each change: on after `hold` seconds of ok, off after `release` without."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        aligned, since, last = state.get if state.exists else (False, -1.0, False)
        out = []
        for t, ok in pd.concat(list(frames)).sort_values("t")[["t", "ok"]].itertuples(index=False):
            if bool(ok) != last or since < 0:
                since, last = float(t), bool(ok)
            if last != aligned and t - since >= (hold if last else release) - 1e-9:
                aligned = last
                out.append((key[0], float(t), bool(aligned)))
        state.update((bool(aligned), float(since), bool(last)))
        yield pd.DataFrame(out, columns=[scan, "t", "aligned"])

    return stream.groupBy(scan).applyInPandasWithState(step, f"{scan} {kind}, t double, aligned boolean", "aligned boolean, since double, last boolean", "append", GroupStateTimeout.NoTimeout)


def newest(stream: DataFrame, keep: int = 240, subject: str = "subject_id", kind: str = "bigint") -> DataFrame:
    """Samples (subject, t, value) -> after each batch, (subject, n, oldest, median) of the newest `keep`. State: that ring."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = state.get if state.exists else ([], [])
        new = pd.concat(list(frames))
        ring = sorted(zip([*times, *new["t"].astype(float)], [*values, *new["value"].astype(float)], strict=True))[-keep:]
        state.update(([t for t, _ in ring], [v for _, v in ring]))
        yield pd.DataFrame([(key[0], len(ring), ring[0][0], float(pd.Series([v for _, v in ring]).median()))], columns=[subject, "n", "oldest", "median"])

    return stream.groupBy(subject).applyInPandasWithState(step, f"{subject} {kind}, n bigint, oldest double, median double", "t array<double>, v array<double>", "update", GroupStateTimeout.NoTimeout)


class Debounce(StatefulProcessor):
    """A flag's state: `steady` since when it has been ok, whether it is shown, and the samples not yet settled.

    Samples are settled in order of time once the watermark has passed them, so that batches and their order change nothing.
    A key has a timer at its first sample that waits, not one a sample, and one `release` after the last ok sample: samples that stop release the flag too. A flag that is released, with no
    sample waiting, has no state (a time to live is for processing time only).
    """

    def __init__(self, scan: str, hold: float, release: float):
        self.scan, self.hold, self.release = scan, int(hold * 1000), int(release * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        shape = T.StructType([T.StructField("since", T.LongType()), T.StructField("last_ok", T.LongType()), T.StructField("shown", T.BooleanType())])
        sample = T.StructType([T.StructField("ms", T.LongType()), T.StructField("ok", T.BooleanType())])
        self.steady = handle.getValueState("steady", shape)
        self.waiting = handle.getListState("waiting", sample)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ms = (pd.to_datetime(new["ts"]).astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
        self.waiting.appendList([(int(t), bool(ok)) for t, ok in zip(ms, new["ok"], strict=True)])
        self.handle.registerTimer(min(ms) + 1)  # one timer a batch: it settles all that the watermark has passed, and sets the next
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get())
        due, later = [s for s in held if s[0] < now], [s for s in held if s[0] >= now]
        since, last_ok, shown = self.steady.get() if self.steady.exists() else (-1, -1, False)
        out = []

        def released(at: int) -> None:
            nonlocal since, shown
            if since >= 0 and at - last_ok >= self.release:
                if shown:
                    out.append((key[0], (last_ok + self.release) / 1000.0, False))
                since, shown = -1, False

        for ms, ok in due:
            released(ms)
            if ok:
                since, last_ok = (ms if since < 0 else since), ms
                if not shown and ms - since >= self.hold:
                    shown = True
                    out.append((key[0], ms / 1000.0, True))
        if not later:
            released(now)
        if later:
            if due:
                self.waiting.put(later)
            self.handle.registerTimer(later[0][0] + 1)
        else:
            self.waiting.clear()
        if since >= 0 or later:
            self.steady.update((since, last_ok, shown))
        else:
            self.steady.clear()
        if since >= 0 and not later and now < last_ok + self.release:
            self.handle.registerTimer(last_ok + self.release)
        return iter([pd.DataFrame(out, columns=[self.scan, "t", "aligned"])] if out else [])

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, hold: float = 1.0, release: float = 0.3, late: str = "0 seconds", scan: str = "scan") -> DataFrame:
    """Alignment flags (scan, ts, ok) -> (scan, t, aligned) at each change, t in epoch seconds: on once the flag has been ok for `hold`
    seconds, off `release` seconds after its last ok sample, whether other samples follow or none does.

    Dips shorter than `release` neither release the flag nor start `hold` anew. Needs STATE_STORE; the end of the stream's
    time is the watermark, so the last release comes once any scan's samples have moved it on.
    """
    kind = stream.schema[scan].dataType.simpleString()
    watched = stream.select(scan, "ts", "ok").withWatermark("ts", late)
    return watched.groupBy(scan).transformWithStateInPandas(Debounce(scan, hold, release), f"{scan} {kind}, t double, aligned boolean", "append", "eventTime")


class Counts(StreamingQueryListener):
    """The last totals that each named stream has observed, summed over its batches: {name: {metric: total}}."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = self.totals.setdefault(name, {})
            for metric, n in row.asDict().items():
                own[metric] = own.get(metric, 0) + (n or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def split_late(batch: DataFrame, newest: float | None, ts: str, late: float) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a batch, given the newest time of all batches before: late is what lies `late` seconds or more before it."""
    if newest is None:
        return batch, batch.limit(0)
    behind = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000.0 <= newest - late, F.lit(False))
    return batch.where(~behind), batch.where(behind)


def with_late(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", late: float = 3600.0, name: str = "late_rows"):
    """Start a query that writes each batch's rows to `path`/in_time or `path`/late (partitioned by `_batch`) and observes both counts
    under `name` (`sent`, `late`), so that emitted + late = sent for every batch and in sum.

    The newest time seen so far is the largest of the written rows, read from one row a batch: a restart goes on where the
    last batch ended, and a batch that is replayed overwrites its own folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        clock = f"{path}/clock"
        seen = spark.read.schema("newest double, _batch bigint").parquet(clock) if number else None
        newest = seen.where(F.col("_batch") < number).agg(F.max("newest")).first()[0] if seen is not None else None
        batch.persist()
        kept, behind = split_late(batch, newest, ts, late)
        counted = Observation(name)
        kept.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/in_time/_batch={number}")
        marked = behind.observe(counted, F.count("*").alias("late"))
        marked.write.mode("overwrite").parquet(f"{path}/late/_batch={number}")
        top = batch.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000.0).alias("newest"), F.count("*").alias("sent"))
        top = top.withColumn("late", F.lit(counted.get["late"])).withColumn("newest", F.greatest("newest", F.lit(newest)))
        top.withColumn("_batch", F.lit(number).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/part={number}")
        batch.unpersist()

    watched = stream.observe(name, F.count("*").alias("sent"))
    return watched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, parts: int = 64):
    """Start a query that keeps a parquet table with the last row of each key.

    Rows lie in `parts` partitions by their key's hash. A batch reads the partitions that it touches, and replaces only these, by
    dynamic partition overwrite; the others keep their files. Each partition remembers its last batch (`_batch`): rows of a
    batch that is replayed are already in it, and of equal rows one stays, so a replay changes nothing.
    """
    from tidemark.operators.facts import keep_last

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        new = batch.withColumn("_batch", F.lit(number).cast("bigint")).withColumn("_part", part)
        touched = sorted(r[0] for r in new.select("_part").distinct().collect())  # at most `parts` numbers
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(path).where(F.col("_part").isin(touched))
        except Exception as error:  # the first batch has no table to read
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old = new.limit(0)
        both = old.where(F.col("_batch") != number).unionByName(new).withColumn("_order", F.struct(order, "_batch"))  # of equal rows the later batch's
        kept = keep_last(both, keys, "_order").drop("_order")
        held = written(kept)  # a table is not overwritten while it is read
        held.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
