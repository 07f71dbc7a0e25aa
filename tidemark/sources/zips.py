"""Zips within zips of any size, as a data source: its partitions are the inner zips that the outer ones list."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.layouts import session_start

#: What a damaged, cut off or encrypted zip raises; a file below its smallest size cannot be sought in.
UNREADABLE = (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError, pa.ArrowException)
SCHEMA = "subject_id string, session string, name string, text string, error string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _outer(path: str) -> Iterator[str]:
    """Files below a folder that are named .zip, or the file itself."""
    system, inside = _opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        yield inside
    elif info.type == fs.FileType.Directory:
        yield from sorted(f.path for f in system.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".zip"))
    else:
        raise FileNotFoundError(path)


class Inner(InputPartition):
    """One inner zip of an outer one; without a name, an outer zip that cannot be read."""

    def __init__(self, outer: str, name: str | None, error: str | None = None):
        super().__init__(name)
        self.outer, self.name, self.error = outer, name, error


class NestedZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """Reads the outer zips' directories alone, which stand at their ends."""
        system, _ = _opened(self.path)
        out: list[InputPartition] = []
        for outer in _outer(self.path):
            try:
                with system.open_input_file(outer) as file, zipfile.ZipFile(file) as z:
                    out.extend(Inner(outer, n) for n in z.namelist() if n.endswith(".zip"))
            except UNREADABLE as error:
                out.append(Inner(outer, None, f"{type(error).__name__}: {error}"))
        return out or [Inner("", None)]

    def read(self, part: Inner) -> Iterator[tuple]:
        if part.name is None:
            if part.error:
                yield None, part.outer.rsplit("/", 1)[-1], None, None, part.error
            return
        subject, session = part.name.split("/")[0] if "/" in part.name else None, part.name.rsplit("/", 1)[-1].removesuffix(".zip")
        system, _ = _opened(self.path)
        at = None
        try:
            with system.open_input_file(part.outer) as file, zipfile.ZipFile(file) as z, zipfile.ZipFile(io.BytesIO(z.read(part.name))) as inner:
                files = [n for n in inner.namelist() if not n.endswith("/")]
                if not files:
                    yield subject, session, None, None, "empty"
                for at in files:
                    yield subject, session, at, inner.read(at).decode("utf-8", "replace"), None
        except UNREADABLE as error:
            yield subject, session, at, None, f"{type(error).__name__}: {error}"


class NestedZips(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nested_zips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return NestedZipReader(self.options["path"])


def read_nested_zips(spark: SparkSession, path: str) -> DataFrame:
    """Zips that hold one zip a session (`subject/15_1594140175.zip`) -> (subject_id, session, t0, name, text, error), a row a file.

    An outer zip may be of any size: a task seeks one inner zip in it and holds that alone. What cannot be read gives a row with an
    error and no text: an outer zip, an inner one, or the file within it at which reading stopped. Folders of stores that pyarrow
    knows (local, HDFS, S3, GCS) can be read.
    """
    spark.dataSource.register(NestedZips)
    return spark.read.format("nested_zips").load(path).withColumn("t0", session_start(F.col("session"))).select("subject_id", "session", "t0", "name", "text", "error")
