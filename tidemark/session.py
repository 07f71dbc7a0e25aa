"""Session settings and null hygiene at the source boundary."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from outside."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def clean_nans(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float and double column: Spark orders NaN above all numbers, the operators want it unknown."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])


def shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base}/run-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: what follows does not compute it anew, and lost executors lose nothing."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
