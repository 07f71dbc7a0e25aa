"""Readers of semi-structured text: wearable CSVs, JSON exports, survey sheets, uploaded night tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_epoch(value: Column) -> Column:
    """Epoch seconds of a field that holds either a number or a timestamp; NULL otherwise."""
    return F.coalesce(value.try_cast("double"), F.unix_micros(F.try_to_timestamp(value)) / 1_000_000.0)


def base_subject(folder: Column) -> Column:
    """Folder name without a trailing part letter (`S11_a`), if more than two characters remain."""
    return F.when((F.length(folder) > 3) & folder.rlike("_[a-z]$"), F.regexp_replace(folder, "_[a-z]$", "")).otherwise(folder)


#: Folders that hold the sessions of one kind.
SESSION_TYPES = ("STRESS", "AEROBIC", "ANAEROBIC")
#: What tells sessions apart: a subject's folder may stand below several kinds.
SESSION = ["session_type", "session"]


def session_of(path: Column) -> list[Column]:
    """(session_type, session, subject_id, part) of a file's path `.../STRESS/S11_a/EDA.csv`: the kind's folder (empty if the one above
    is no kind), the subject's folder, its subject, and the letter of a split recording (empty if it is not split)."""
    parts = F.split(path, "/")
    above, folder = F.coalesce(F.get(parts, F.size(parts) - 3), F.lit("")), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    kind = F.when(above.isin(*SESSION_TYPES), above).otherwise("")
    subject = base_subject(folder)
    part = F.when(subject != folder, F.substring(folder, -1, 1)).otherwise("")
    return [kind.alias("session_type"), folder.alias("session"), subject.alias("subject_id"), part.alias("part")]


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, text) of whole files below a folder; a file is one row, read where its block is."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def read_signals(spark: SparkSession, path: str, names: tuple[str, ...] = ("BVP", "EDA", "TEMP", "HR", "ACC")) -> DataFrame:
    """Wristband CSVs -> (session_of, name, t0, fs, values array<array<double>>): line 1 the start, line 2 the rate, then samples.

    Files that are missing, too short or without a readable head are left out.
    """
    f = _files(spark, path, "*.csv").withColumn("name", F.upper(F.regexp_extract("path", r"([^/]+)\.csv$", 1))).where(F.col("name").isin(*names))
    lines = F.filter(F.split("text", r"\r?\n"), lambda s: F.trim(s) != "")
    f = f.withColumn("_l", lines).where(F.size("_l") >= 3)
    head = lambda k: F.trim(F.get(F.split(F.get("_l", F.lit(k)), ","), F.lit(0)))
    body = F.transform(F.slice("_l", F.lit(3), F.size("_l") - 2), lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double")))
    out = f.select(*session_of(F.col("path")), "name", as_epoch(head(0)).alias("t0"), head(1).try_cast("double").alias("fs"), body.alias("values"))
    return out.where(F.col("t0").isNotNull() & (F.col("fs") > 0))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Beat-interval CSVs (start in line 1, then offset, interval) -> (session_of, t, ibi); malformed lines are left out."""
    f = _files(spark, path, "IBI.csv").select(*session_of(F.col("path")), F.split("text", r"\r?\n").alias("_l"))
    who = ["session_type", "session", "subject_id", "part"]
    start = as_epoch(F.trim(F.get(F.split(F.get("_l", F.lit(0)), ","), F.lit(0))))
    rows = f.select(*who, start.alias("_t0"), F.explode(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))).alias("_s"))
    at = lambda k: F.trim(F.get(F.split("_s", ","), F.lit(k))).try_cast("double")
    return rows.select(*who, (F.col("_t0") + at(0)).alias("t"), at(1).alias("ibi")).where("t is not null and ibi is not null")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tag files -> (session_of, tags): sorted epochs."""
    f = _files(spark, path, "tags.csv").select(*session_of(F.col("path")), F.split("text", r"\r?\n").alias("_l"))
    return f.select("session_type", "session", "subject_id", "part", F.array_sort(F.filter(F.transform("_l", lambda s: as_epoch(F.trim(s))), lambda t: t.isNotNull())).alias("tags"))


def read_columns(spark: SparkSession, path: str, schema: str, renames: dict[str, str], optional: tuple[str, ...] = (), pattern: str = "*.csv") -> DataFrame:
    """CSVs below a folder with a fixed schema and renames; an optional column that no file has comes out NULL."""
    have = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path).columns
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)
    out = []
    for part in schema.split(","):
        name, kind = part.split()
        col = F.col(f"`{name}`").try_cast(kind) if name in have else F.lit(None).cast(kind)
        if name not in have and name not in optional:
            raise ValueError(f"no column {name} in {path}")
        out.append(col.alias(renames.get(name, name)))
    return df.select(*out)


def read_sleep(spark: SparkSession, path: str) -> DataFrame:
    """Sleep JSON (an array of logs with levels.data) -> (start, end) of the stretches asleep."""
    schema = "dateOfSleep string, levels struct<data: array<struct<dateTime: string, level: string, seconds: bigint>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("levels.data").alias("d"))
    start = F.try_to_timestamp(F.col("d.dateTime"))
    d = d.where(F.col("d.level").isin("asleep", "light", "deep", "rem"))
    return d.select(start.alias("start"), F.timestamp_micros(F.unix_micros(start) + F.col("d.seconds") * 1_000_000).alias("end"))


def read_daily_value(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON rows of (dateTime, value) -> (day, name): daily sums; values that are no numbers are skipped."""
    d = spark.read.schema("dateTime string, value string").json(path, multiLine=True)
    return d.groupBy(F.to_date(F.try_to_timestamp("dateTime")).alias("day")).agg(F.sum(F.col("value").try_cast("double")).alias(name))


def read_heart_rate(df: DataFrame, col: str = "text") -> DataFrame:
    """Large heart-rate exports read by pattern instead of parsed: text -> (ts, bpm)."""
    pattern = r'"dateTime"\s*:\s*"([^"]+)"[^}]*?"bpm"\s*:\s*(\d+(?:\.\d+)?)'
    pairs = F.arrays_zip(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(col, F.lit(pattern), F.lit(2)).alias("b"))
    return df.select(F.explode(pairs).alias("p")).select(F.try_to_timestamp("p.t").alias("ts"), F.col("p.b").try_cast("double").alias("bpm"))


def read_heart_rate_files(spark: SparkSession, path: str) -> DataFrame:
    """Large heart-rate exports, arrays without line ends, -> (ts, bpm), a row a record with a rate.

    A file is read as lines that end with a closing brace, so Spark splits it by bytes: a record that a split cuts belongs to the
    split in which its line begins. No task holds more than a split and a record.
    """
    return read_heart_rate(spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path), "value")


def any_yes_per_day(survey: DataFrame, day: str, answer: str, out: str) -> DataFrame:
    """Survey rows with dd/MM/yyyy days and Yes/No/other answers -> (day, out): any yes; other answers are unknown."""
    said = F.when(F.col(answer) == "Yes", True).when(F.col(answer) == "No", False)
    return survey.groupBy(F.to_date(F.try_to_timestamp(day, F.lit("dd/MM/yyyy"))).alias("day")).agg(F.coalesce(F.bool_or(said), F.lit(False)).alias(out))


def lowest_per_local_day(survey: DataFrame, ts: str, value: str, zone: str) -> DataFrame:
    """UTC survey rows -> (day, value): the local day's lowest answer."""
    return survey.groupBy(F.to_date(F.from_utc_timestamp(F.try_to_timestamp(ts), zone)).alias("day")).agg(F.min(F.col(value).try_cast("double")).alias(value))


def survey_intervals(sheet: DataFrame, day: str, start: str, end: str, zone: str) -> DataFrame:
    """Local day and HH:mm times -> (start, end) epochs; an end before its start is on the next day. DST is honoured."""
    local = lambda c: F.try_to_timestamp(F.concat_ws(" ", F.col(day).cast("string"), F.trim(F.col(c))))
    finish = F.when(local(end) < local(start), local(end) + F.expr("INTERVAL 1 DAY")).otherwise(local(end))
    at = lambda t: F.unix_timestamp(F.to_utc_timestamp(t, zone))
    return sheet.withColumn("start_s", at(local(start))).withColumn("end_s", at(finish)).where("start_s is not null and end_s is not null")


def listed_dates(cell: Column) -> Column:
    """Dates in a text such as `[Timestamp('2020-03-01 00:00:00'), NaT]`."""
    return F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.to_date(d))


def label_sheet(sheet: DataFrame, subject: str = "ParticipantID", category: str = "Category", dates: dict[str, str] | None = None) -> DataFrame:
    """A sheet with timestamp-list cells -> (subject_id, category, an array of dates for each of `dates`); rows without a subject go."""
    dates = dates or {"symptom": "Symptom_dates", "diagnosis": "covid_diagnosis_dates", "recovery": "recovery_dates"}
    known = sheet.where(F.col(subject).isNotNull())
    return known.select(F.col(subject).cast("string").alias("subject_id"), F.col(category).cast("string").alias("category"), *[listed_dates(F.col(c)).alias(n) for n, c in dates.items()])


def label_events(labels: DataFrame, category: str, which: str = "symptom") -> DataFrame:
    """Labels -> (subject_id, day): the listed days of a category's subjects, once each."""
    return labels.where(F.col("category") == category).select("subject_id", F.explode(which).alias("day")).distinct()


def find_tables(spark: SparkSession, path: str, files: list[str], folders: list[str] = ()) -> DataFrame:
    """Tables below a folder, however deep -> (name, path): `name`.csv files and folders of that name, the first path of each. No content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    pieces = F.split("path", "/")
    last, kinds = F.element_at(pieces, -1), [F.struct(F.lit(n).alias("name"), F.when(F.element_at(pieces, -1) == f"{n}.csv", F.col("path")).alias("path")) for n in files]
    kinds += [F.struct(F.lit(n).alias("name"), F.when((last != n) & F.array_contains(F.slice(pieces, F.lit(1), F.size(pieces) - 1), n), F.array_join(F.slice(pieces, F.lit(1), F.array_position(pieces, n).cast("int")), "/")).alias("path")) for n in folders]
    return listed.select(F.inline(F.array(*kinds))).where("path is not null").groupBy("name").agg(F.min("path").alias("path"))


def json_items(df: DataFrame, col: str, schema: str) -> DataFrame:
    """`df` without the JSON text column, with one row (key, value) for each of its entries; text that is no object has none."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(F.from_json(col, schema)).alias("key", "value"))


def as_minutes(value: Column) -> Column:
    """A duration given in hours (16 at most) or in minutes."""
    return F.when(value <= 16, value * 60).otherwise(value)


def page_table(pages: DataFrame) -> DataFrame:
    """Raw web pages -> (page_id, lang, title_chars, links)."""
    return pages.select(
        "page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("bigint").alias("title_chars"),
        F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("bigint").alias("links"),
    )


#: Header names of an uploaded night table, lower-cased, and the role each names.
ROLES = {
    "day": ["date", "day", "night", "날짜", "일자"],
    "night_hr": ["hr", "heart rate", "night hr", "resting hr", "심박", "심박수", "수면 심박"],
    "asleep": ["sleep", "asleep", "sleep minutes", "sleep hours", "수면", "수면시간"],
    "steps": ["steps", "걸음", "걸음수"],
}


def import_nights(spark: SparkSession, rows: DataFrame, col: str = "value", head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Delimited text lines with a header -> (accepted nights, counts of accepted and rejected rows).

    The header is `head` if given, else the line that holds most of the roles' names, the least of equals: lines of a table
    come in no order. The separator is the one of tab, semicolon and comma that the header has most of; roles follow header aliases; a
    heart rate must lie within 30 to 120, a date must parse.
    """
    if head is None:
        names = F.split(F.lower(F.regexp_replace(col, '"', "")), "[\\t;,]")
        known = F.array(*[F.lit(n) for alias in ROLES.values() for n in alias])
        n = F.size(F.array_intersect(F.transform(names, F.trim), known))
        head = rows.where(F.col(col).isNotNull()).agg(F.min(F.struct((-n).alias("n"), F.col(col).alias("line")))["line"]).first()[0] or ""
    sep = max("\t;,", key=head.count)
    names = [h.strip().strip('"').lower() for h in head.split(sep)]
    at = {role: next((k for k, n in enumerate(names) if n in alias), None) for role, alias in ROLES.items()}
    cells = F.split(col, "\\" + sep if sep != "\t" else "\t", -1)
    cell = lambda role: F.trim(F.regexp_replace(F.get(cells, F.lit(at[role])), '"', "")) if at[role] is not None else F.lit(None).cast("string")
    number = lambda role: F.regexp_replace(cell(role), "[^0-9.+-]", "").try_cast("double")
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(F.substring(cell("day"), 1, 10), F.lit(p))) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")])
    parsed = rows.where(F.col(col) != head).select(day.alias("day"), number("night_hr").alias("night_hr"), as_minutes(number("asleep")).alias("asleep"), number("steps").alias("steps"))
    ok = F.col("day").isNotNull() & F.coalesce(F.col("night_hr").between(30, 120), F.lit(False))
    return parsed.where(ok), parsed.agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("skipped"))
