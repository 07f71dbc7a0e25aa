"""Exports, surveys and sheets that Spark writes from `events` and the readers read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.session import shared
from tidemark.sources import layouts, text

ZONE = "Asia/Seoul"


#: Fixed value: users whose export is one file; a file for each would leave more files than rows can pay for.
USERS = 50


def _stamp(ts="ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, floor(value) AS bpm FROM events")
def text_heart_rate(spark, read):
    """A heart-rate export without line ends, read in splits of its bytes."""
    record = F.concat(F.lit('{"dateTime": "'), _stamp(), F.lit('", "value": {"bpm": '), F.floor("value").cast("string"), F.lit(', "confidence": 2}}'))
    path = shared(spark)
    read("events").select(record.alias("value")).write.option("lineSep", ", ").text(path)
    return text.read_heart_rate_files(spark, path).select(_stamp().alias("at"), "bpm")


#: Stages of a sleep log by kind of event; restless and wake are not sleep.
STAGES = {"purchase": "deep", "view": "light", "error": "wake", "signup": "rem", "click": "restless"}


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM events WHERE event_type IN ('purchase', 'view', 'signup')")
def text_sleep(spark, read):
    """Sleep exports, a file for USERS user numbers: the stretches asleep."""
    stage = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STAGES.items()])
    stretch = F.struct(_stamp().alias("dateTime"), stage.alias("level"), F.floor("value").alias("seconds"))
    logs = read("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_list(stretch).alias("data"))
    export = logs.groupBy(F.floor(F.col("user_id") / USERS).alias("users")).agg(F.to_json(F.collect_list(F.struct(F.col("d").cast("string").alias("dateOfSleep"), F.struct("data").alias("levels")))).alias("value"))
    path = shared(spark)
    export.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return text.read_sleep(spark, path).select(_stamp("start").alias("start"), _stamp("end").alias("end"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type <> 'error') AS DOUBLE) AS steps FROM events GROUP BY 1")
def text_daily_value(spark, read):
    """Daily sums of step exports, a file for USERS user numbers; entries that are no numbers are skipped."""
    entry = F.struct(_stamp().alias("dateTime"), F.when(F.col("event_type") == "error", "unknown").otherwise(F.floor("value").cast("string")).alias("value"))
    path = shared(spark)
    read("events").groupBy(F.floor(F.col("user_id") / USERS).alias("users")).agg(F.to_json(F.collect_list(entry)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return text.read_daily_value(spark, path, "steps").select(F.col("day").cast("string").alias("day"), "steps")


@query("SELECT user_id, value AS x, CAST(NULL AS VARCHAR) AS note FROM events")
def text_columns(spark, read):
    """CSVs with a header, read by name: one column renamed, one optional and absent."""
    path = shared(spark)
    read("events").select("event_id", "value", "user_id").write.option("header", True).csv(path)
    return text.read_columns(spark, path, "user_id bigint, value double, note string", {"value": "x"}, ("note",))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, coalesce(bool_or(CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN false END), false) AS drank FROM events GROUP BY 1")
def survey_any_yes(spark, read):
    """A survey with dd/MM/yyyy days and Yes, No or other answers."""
    answer = F.when(F.col("event_type") == "purchase", "Yes").when(F.col("event_type") == "view", "No").otherwise("rather not say")
    sheet = read("events").select(F.date_format("ts", "dd/MM/yyyy").alias("day"), answer.alias("answer"))
    return text.any_yes_per_day(sheet, "day", "answer", "drank").select(F.col("day").cast("string").alias("day"), "drank")


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, min(value) AS stress FROM events GROUP BY 1")
def survey_local_day(spark, read):
    """Answers at UTC times: the lowest of each local day."""
    sheet = read("events").select(_stamp().alias("at"), F.col("value").cast("string").alias("stress"))
    return text.lowest_per_local_day(sheet, "at", "stress", ZONE).select(F.col("day").cast("string").alias("day"), "stress")


@query("""WITH s AS (SELECT event_id, CAST(ts AS DATE) AS d, CAST(strftime(ts, '%H:%M:00') AS TIME) AS a, CAST(strftime(ts + to_minutes(CAST(floor(value * 3) AS BIGINT)), '%H:%M:00') AS TIME) AS b FROM events)
SELECT event_id, CAST(epoch(d + a) - 32400 AS BIGINT) AS start_s, CAST(epoch(d + b) + CASE WHEN b < a THEN 86400 ELSE 0 END - 32400 AS BIGINT) AS end_s FROM s""")
def survey_spans(spark, read):
    """Days with times of start and end on a local clock; an end before its start is tomorrow's."""
    later = F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 3).cast("int"))
    sheet = read("events").select("event_id", F.to_date("ts").alias("day"), F.date_format("ts", " HH:mm").alias("a"), F.date_format(later, "HH:mm ").alias("b"))
    return text.survey_intervals(sheet, "day", "a", "b", ZONE).select("event_id", "start_s", "end_s")


@query("""WITH e AS (SELECT event_id, value, event_type FROM events WHERE event_type <> 'signup' AND event_type <> 'click')
SELECT 'E' || event_id AS id, 'Stroop' AS stage, value AS score FROM e WHERE event_type = 'view' UNION ALL SELECT 'E' || event_id, 'Rest', CAST(event_id % 7 AS DOUBLE) FROM e""")
def wide_sheet(spark, read):
    """A sheet of text cells, excluded rows left out, as rows of numbers: a cell that is none says nothing."""
    score = F.when(F.col("event_type") == "view", F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise("absent")
    excluded = F.when(F.col("event_type") == "signup", "True").when(F.col("event_type") != "click", "False")  # unknown of a click
    sheet = read("events").select(F.concat(F.lit(" E"), "event_id", F.lit(" ")).alias("id"), score.alias(" Stroop"), (F.col("event_id") % 7).cast("string").alias("Rest "), excluded.alias("ml_excluded"))
    return layouts.long_sheet(layouts.numeric_sheet(layouts.usable_rows(sheet).drop("ml_excluded"), "id"), "id")
