"""What several operators share: tables, materialised intermediates, membership bitmaps, successors."""

from __future__ import annotations

import os
import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast on purpose only below this many rows; past it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(path, exist_ok=True)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if a count proves that it has at most `rows` narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bits_for(keys: int, per_key: int = 64, least: int = 1 << 14, most: int = 1 << 23) -> int:
    """Bitmap size for so many keys: a power of two, bounded (2**23 bits are 1 MB)."""
    bits = least
    while bits < keys * per_key and bits < most:
        bits *= 2
    return bits


def _probes(key: Column, bits: int, probes: int) -> list[Column]:
    """Bit numbers of a 64-bit key: consecutive 24-bit slices of it."""
    return [F.shiftrightunsigned(key, 20 * i).bitwiseAND(F.lit(bits - 1)) for i in range(probes)]


def bitmap(keys: DataFrame, key: str, bits: int, probes: int) -> DataFrame:
    """One row, one column `bitmap`: array<bigint> of bits/64 words with the probe bits of every key set.

    Its size depends on `bits` alone, so it may be sent to every task whatever the input.
    """
    spark = keys.sparkSession
    words = (
        keys.select(F.explode(F.array(*_probes(F.col(key), bits, probes))).alias("_bit"))
        .groupBy(F.shiftrightunsigned("_bit", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_mask"))
    )
    dense = spark.range(bits // 64).join(words, F.col("id") == F.col("_word"), "left")
    return dense.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("_mask", F.lit(0).cast("bigint")).alias("m")))).alias("s")).select(
        F.col("s.m").alias("bitmap")
    )


def with_bitmap(df: DataFrame, wanted: Column, keys: DataFrame, name: str = "_bitmap") -> DataFrame:
    """`df` with the one-row bitmap as column `name` where `wanted` holds, else null: a join with one broadcast row, a nested loop in Spark's plan."""
    one = F.broadcast(keys.select(F.col("bitmap").alias(name), F.lit(True).alias("_bitmap_on")))
    return df.withColumn("_bitmap_for", wanted).join(one, F.col("_bitmap_for") == F.col("_bitmap_on"), "left").drop("_bitmap_for", "_bitmap_on")


def in_bitmap(words: Column, key: Column, bits: int, probes: int) -> Column:
    """Whether all probe bits of `key` are set: true for every key of the bitmap, and for few others."""
    out = None
    for bit in _probes(key, bits, probes):
        hit = F.call_function("getbit", F.get(words, F.shiftrightunsigned(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        out = hit if out is None else out & hit
    return out


def dealt(rows: DataFrame, keys: list[str], per_bucket: int, most_steps: int = 12) -> DataFrame:
    """`rows` with a bigint column `_b`: buckets of rows that are neighbours by the bigint columns `keys`, none null.

    A bucket above four times `per_bucket` rows is divided into ranges of equal width of its first key that differs within
    it, and its parts again, until none is: an outlying id or ids in clusters cost a step, not a crowded bucket. Only rows
    that agree in all keys cannot be divided. Each step counts the buckets; the rows meet the crowded ones by an equi-join.
    """
    ends = [f(k).alias(f"_{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))]
    whole = rows.agg(F.count("*").alias("_n"), *ends).first()
    wide = [k for k in keys if whole["_n"] > 4 * per_bucket and whole[f"_high_{k}"] > whole[f"_low_{k}"]]
    if not wide:
        return rows.withColumn("_b", F.lit(0).cast("bigint"))
    low, high = whole[f"_low_{wide[0]}"], whole[f"_high_{wide[0]}"]
    width = max(1, -(-(high - low + 1) * per_bucket // whole["_n"]))
    rows = rows.withColumn("_b", F.floor((F.col(wide[0]).cast("decimal(38,0)") - F.lit(Decimal(low))) / F.lit(Decimal(width))).cast("bigint"))
    for _ in range(most_steps):
        counts = rows.groupBy("_b").agg(F.count("*").alias("_n"), *ends).where(F.col("_n") > 4 * per_bucket)
        differing = [F.when(F.col(f"_high_{k}") > F.col(f"_low_{k}"), F.lit(i)) for i, k in enumerate(keys)]
        counts = counts.withColumn("_at", F.coalesce(*differing, F.lit(None).cast("int"))).where("_at is not null")
        chosen = lambda n: F.get(F.array(*[F.col(f"_{n}_{k}") for k in keys]), F.col("_at")).cast("decimal(38,0)")  # noqa: E731, B023
        crowded = counts.select("_b", "_at", chosen("low").alias("_low"), F.ceil((chosen("high") - chosen("low") + 1) * per_bucket / F.col("_n")).cast("decimal(38,0)").alias("_width"))
        crowded = stash(crowded)
        if crowded.isEmpty():
            break
        met = rows.join(small(crowded), "_b", "left")
        place = F.floor((F.get(F.array(*keys), F.col("_at")).cast("decimal(38,0)") - F.col("_low")) / F.greatest("_width", F.lit(1)))
        rows = met.withColumn("_b", F.when(F.col("_at").isNull(), F.col("_b")).otherwise(F.xxhash64("_b", "_at", place.cast("bigint")))).drop("_at", "_low", "_width")
    return rows


def successors(ids: DataFrame, per_bucket: int = 2000, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Distinct rows of bigint columns `keys`, none null -> (keys, next_ of each), the largest row's next being the smallest.

    Rows are dealt to buckets of about `per_bucket` neighbours; the successor of a bucket's last row is the first row of
    the next bucket, found by the same step over the buckets' first rows. No task sorts more than four times a bucket.
    """
    n, least = ids.agg(F.count("*"), F.min(F.struct(*keys))).first()
    spread = lambda c: [c[k].alias(f"next_{k}") for k in keys]
    if n <= 2 * per_bucket:
        wrap = F.struct(*[F.lit(least[k] if least else 0).cast("bigint").alias(k) for k in keys])
        return ids.select(*keys, F.coalesce(F.lead(F.struct(*keys)).over(Window.orderBy(*keys)), wrap).alias("_next")).select(*keys, *spread(F.col("_next")))
    b = dealt(ids.select(*keys), list(keys), per_bucket)
    firsts = stash(b.groupBy("_b").agg(F.min(F.struct(*keys)).alias("_first")).select("_b", "_first.*"))
    ends = firsts.join(successors(firsts.select(*keys), per_bucket, keys), list(keys)).select("_b", F.struct(*[F.col(f"next_{k}").alias(k) for k in keys]).alias("_after"))
    led = b.withColumn("_lead", F.lead(F.struct(*keys)).over(Window.partitionBy("_b").orderBy(*keys)))
    return led.join(ends, "_b").select(*keys, F.coalesce("_lead", "_after").alias("_next")).select(*keys, *spread(F.col("_next")))
