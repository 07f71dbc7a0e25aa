"""Streams run to their end over the driver's tables, and models with out-of-fold predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics, models
from tidemark.plans import judgement
from tidemark.plans.registry import QUERIES, query, rounded
from tidemark.session import shared
from tidemark.streaming import live


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All the rows that the stream emits over what its source holds now, as a table in the shared folder."""
    path = shared(spark)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def as_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A batch table written to the shared folder and read as a stream."""
    path = f"{shared(spark)}/in"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_stream(spark, e.select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("value") > 50).alias("carried")))


def stream_day_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days closed by the watermark; the last ones stay open."""
    return run_to_end(spark, live.fold_days(_events(spark, sf_dir), min_windows=3))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(spark, live.sessions(_events(spark, sf_dir), ["subject_id"], gap="6 hours", late="1 hour"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day verdicts as a stream; equals the batch alerts."""
    days = judgement.verdicts(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")).select("subject_id", "day", "carried_frac", "valid", "held")
    return run_to_end(spark, live.alerts(as_stream(spark, days), 0.5, 2))


QUERIES |= {f.__name__: f for f in (stream_day_fold, stream_sessions, stream_alerts)}


@query()
def model_out_of_fold(spark, read):
    """Quality of logistic regression on day features, subjects kept together."""
    df = models.with_folds(judgement.features(read), folds=3)
    p = models.out_of_fold(df, "logistic", ["hr_mean", "rmssd", "mean_tonic_eda", "peaks_density"], keys=("subject_id", "day"))
    out = metrics.class_metrics(p, "label", "pred_label", ["REST", "STRESS", "EXERCISE"], ("fold",))
    return rounded(out, "accuracy", "macro_f1", "balanced_accuracy", "abstain_rate", "f1_rest", "f1_stress", "f1_exercise", digits=3)


@query()
def risk_labels(spark, read):
    """Days labelled by their distance from events, those of all subjects."""
    return models.label_around(judgement.verdicts(read).select("subject_id", "day", "z"), judgement.events_of(read))


@query()
def risk_out_of_fold(spark, read):
    """The risk of each day by a model of all other subjects, every subject a fold of its own, and its level."""
    w = Window.partitionBy("subject_id").orderBy("day").rowsBetween(-2, 0)
    days = judgement.verdicts(read).select("subject_id", "day", "valid", "z").withColumn("z3", F.avg("z").over(w)).withColumn("dev3", F.sum(F.coalesce(F.col("z") >= 1.0, F.lit(False)).cast("double")).over(w))
    labelled = models.label_around(days, judgement.events_of(read))
    return rounded(models.risk_levels(models.risk_out_of_fold(labelled, ["z", "z3", "dev3"], how="loso")), "p", digits=4)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert(spark, read):
    """A table of each user's last event, kept by partition from a stream of events."""
    path = shared(spark)
    source = as_stream(spark, read("events").select("user_id", "event_id", "value"))
    live.upsert_batches(source, f"{path}/table", ["user_id"], "event_id", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("user_id", "event_id", "value")


@query("SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events")
def stream_distinct(spark, read):
    """Events that come twice, in any order, once each."""
    e = read("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = run_to_end(spark, live.distinct_frames(as_stream(spark, e.unionByName(e)), ["user_id"], late="400 days"))
    return got.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("""WITH s AS (SELECT user_id, value, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS a FROM events, range(4) r(k))
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(median(value), 6) AS median FROM s
GROUP BY user_id, a HAVING count(*) >= 3 AND a + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 SECOND FROM events)""")
def stream_median(spark, read):
    """Every six hours each user's median of a day, as windows that the watermark has closed."""
    e = read("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    got = run_to_end(spark, live.sliding_median(as_stream(spark, e), ["user_id"], "value", length="1 day", step="6 hours"))
    return rounded(got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "median"), "median")


@query()
def stream_debounce(spark, read):
    """Changes of a flag a user, shown after six hours of high values and released six hours after the last, by timers."""
    e = read("events").select(F.col("user_id").alias("scan"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("ok"))
    key, store = live.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        return run_to_end(spark, live.debounced(as_stream(spark, e), hold=6 * 3600.0, release=6 * 3600.0))
    finally:
        spark.conf.set(key, before)
