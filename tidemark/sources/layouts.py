"""Folder and sheet layouts: sessions in zips and in folders, device files, wide sheets, feature tables, frame logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import text

# -- sessions ------------------------------------------------------------------------------------------------


def session_start(session: Column) -> Column:
    """Start epoch at the end of a session's name such as `15_1594140175`; NULL where that is no number."""
    return F.element_at(F.split(session, "_"), -1).try_cast("double")


def read_zipped_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Zips that hold one zip a session (`subject/15_1594140175.zip`) -> (subject_id, session, t0, name, text), a row a file.

    An outer zip is one row, of 2 GB at most (Spark's bound for a binary file); a task unpacks one session at a time. A
    zip that cannot be read, inner or outer, is left out.
    """

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for folder, session, inner in _inner(content):
                    files = [(folder, session, n, inner.read(n).decode("utf-8", "replace")) for n in inner.namelist() if not n.endswith("/")]
                    yield pd.DataFrame(files, columns=["subject_id", "session", "name", "text"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    files = raw.select("content").mapInPandas(unpack, "subject_id string, session string, name string, text string")
    return files.withColumn("t0", session_start(F.col("session")))


def _inner(content: bytes) -> Iterator[tuple[str, str, zipfile.ZipFile]]:
    """(first folder, name without extension, opened zip) of each zip within a zip."""
    try:
        outer = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    for name in outer.namelist():
        if name.endswith(".zip"):
            try:
                yield name.split("/")[0], name.rsplit("/", 1)[-1].removesuffix(".zip"), zipfile.ZipFile(io.BytesIO(outer.read(name)))
            except zipfile.BadZipFile:
                continue


def list_sessions(spark: SparkSession, path: str, kind: str = "SHIFT") -> DataFrame:
    """Folders `subject/session` that hold files -> (subject_id, session, session_type, t0). File contents are not read."""
    parts = F.split("path", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    names = files.select(F.element_at(parts, -3).alias("subject_id"), F.element_at(parts, -2).alias("session")).distinct()
    return names.select("subject_id", "session", F.lit(kind).alias("session_type"), session_start(F.col("session")).alias("t0"))


def discover_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Folders `type/subject` that hold files -> (session_type, session, subject_id, part, n_files, path). File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = files.select(*text.session_of(F.col("path")), F.regexp_replace("path", "/[^/]*$", "").alias("path")).where("session_type <> ''")
    return named.groupBy(*named.columns).agg(F.count("*").alias("n_files")).select("session_type", "session", "subject_id", "part", "n_files", "path")


def session_spans(signals: DataFrame, name: str = "BVP") -> DataFrame:
    """Signals (sources.text.read_signals) -> (session_type, session, subject_id, part, start, end, seconds) by the samples of one of them."""
    seconds = F.size("values") / F.col("fs")
    ours = signals.where((F.col("name") == name) & (F.size("values") > 0))
    return ours.select(*WHO, F.col("t0").alias("start"), (F.col("t0") + seconds).alias("end"), seconds.alias("seconds"))


#: What tells a session, whose it is, and its part.
WHO = ["session_type", "session", "subject_id", "part"]


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row a session -> (WHO, signals map<name, struct<t0, fs, values>>, intervals array<struct<t, ibi>>, tags).

    A session is a folder below one of a kind: a subject's folders of two kinds, and its parts, are sessions of their own. It
    has a row if any of its files can be read; what is missing is an empty map or array.
    """
    folded = text.read_signals(spark, path).groupBy(*WHO).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("t0", "fs", "values")))).alias("signals"))
    beats = text.read_intervals(spark, path).groupBy(*WHO).agg(F.array_sort(F.collect_list(F.struct("t", "ibi"))).alias("intervals"))
    joined = folded.join(beats, WHO, "full").join(text.read_tags(spark, path), WHO, "full")
    empty = {f.name: "map()" if f.name == "signals" else "array()" for f in joined.schema if f.name not in WHO}
    return joined.select(*WHO, *[F.coalesce(c, F.expr(e).cast(joined.schema[c].dataType)).alias(c) for c, e in empty.items()])


def merged_parts(signals: DataFrame) -> DataFrame:
    """Signals of split recordings -> one row for each (session_type, subject_id, name): parts in order of their starts.

    -> (session_type, subject_id, name, pieces array<struct<t0, fs, values>>). The gap between parts stays one: samples are not joined.
    """
    pieces = F.array_sort(F.collect_list(F.struct("t0", "fs", "values")))
    return signals.groupBy("session_type", "subject_id", "name").agg(pieces.alias("pieces"))


# -- device files --------------------------------------------------------------------------------------------
#: Fixed value: names of device files, `ID[_number]_kind[_longterm].csv`.
DEVICE_FILE = r"^([A-Z0-9]+)(?:_\d+)?_(hr|steps|sleep)(?:_longterm)?\.csv$"


def read_devices(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """All files of a kind (hr, steps, sleep), of any device or period -> (subject_id, columns of the schema); others are left out.

    The files of a kind share their header; values that do not parse are NULL.
    """
    files = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{kind}*.csv").csv(path)
    file = F.col("_metadata.file_name")
    ours = files.where(F.regexp_extract(file, DEVICE_FILE, 2) == kind)
    return ours.select(F.regexp_extract(file, DEVICE_FILE, 1).alias("subject_id"), *files.columns)


# -- sheets --------------------------------------------------------------------------------------------------
def numeric_sheet(sheet: DataFrame, key: str) -> DataFrame:
    """A wide sheet with trimmed names and keys and numbers elsewhere; what is no number is NULL."""
    return sheet.select(*[(F.trim(F.col(f"`{c}`").cast("string")) if c == key else F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")).alias(c.strip()) for c in sheet.columns])


def long_sheet(sheet: DataFrame, key: str, names: tuple[str, str] = ("stage", "score")) -> DataFrame:
    """A numeric sheet -> (key, stage, score), a row a cell that holds a number."""
    return sheet.unpivot([key], [c for c in sheet.columns if c != key], *names).where(F.col(names[1]).isNotNull())


def usable_rows(features: DataFrame, drop_excluded: bool = True, drop_flagged: bool = False) -> DataFrame:
    """Feature rows without the excluded (and perhaps flagged) ones. An unknown mark counts as set; a missing column marks none."""
    for column, drop in (("ml_excluded", drop_excluded), ("flagged", drop_flagged)):
        if drop and column in features.columns:
            features = features.where(~F.coalesce(F.col(column).try_cast("boolean"), F.lit(True)))
    return features


# -- frame logs ----------------------------------------------------------------------------------------------
def _lines(log: Column) -> Column:
    return F.filter(F.transform(F.split(log, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")


def frame_seconds(log: Column) -> Column:
    """A log of `frame  timestamp` lines -> seconds of each frame since the first; a line without a second part is left out."""
    stamps = F.filter(F.transform(_lines(log), lambda s: F.regexp_extract(s, r"^\S+\s+(.+)$", 1)), lambda s: s != "")
    at = F.transform(stamps, lambda s: F.unix_micros(F.try_to_timestamp(s)) / 1_000_000.0)
    return F.transform(at, lambda t: t - F.get(at, F.lit(0)))


def frame_values(log: Column) -> Column:
    """A log of `value  interval` lines -> the values."""
    return F.transform(_lines(log), lambda s: F.get(F.split(s, r"\s+"), F.lit(0)).try_cast("double"))
