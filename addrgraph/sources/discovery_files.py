"""Discovery sources as a Spark data source: one folder or file per source, batch or stream.

Below ``path`` stands ``<source>.<format>``, a file or a folder of files.  Each source file
is a partition of its own and is read by the reader of its format; names outside ``sources``
are not opened.  A file that cannot be read takes down neither the others nor the job: it
gives one row with the error and none of its records.  The functions go to the executors by
value.  Files are opened with pyarrow's file systems (local and shared mounts, HDFS, object
stores); for a store that only Spark can open, use ``read_discovery`` on Spark's readers.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from addrgraph.operators.enrich import selected_sources
from addrgraph.sources.discovery import load_discovery

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "discovery_files"
SCHEMA = "rec_id long, source string, kind string, value string, error string"


def _json_rows(stream) -> Iterator[dict]:
    for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
        if line.strip():
            row = json.loads(line)
            if not isinstance(row, dict):
                raise ValueError("a line is not an object")
            yield row


def _csv_rows(stream) -> Iterator[dict]:
    yield from csv.DictReader(io.TextIOWrapper(stream, "utf-8", newline=""))


def _parquet_rows(stream) -> Iterator[dict]:
    import pyarrow.parquet as pq

    for batch in pq.ParquetFile(io.BytesIO(stream.read())).iter_batches():
        yield from batch.to_pylist()


#: Readers by format; each yields records with ``kind`` and ``value`` and perhaps ``rec_id``.
READERS = {"json": _json_rows, "csv": _csv_rows, "parquet": _parquet_rows}


@dataclass
class SourceFile(InputPartition):
    source: str
    fmt: str
    path: str
    changed: int

    def __init__(self, source: str, fmt: str, path: str, changed: int):
        super().__init__(path)
        self.source, self.fmt, self.path, self.changed = source, fmt, path, changed


def _open(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def source_files(path: str, sources: list[str]) -> list[SourceFile]:
    """The sources' files, by time of change and name; hidden files and empty markers are left out."""
    from pyarrow import fs

    files, top = _open(path)
    found = []
    for entry in files.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        source, _, fmt = entry.base_name.rpartition(".")
        if source.lower() not in sources or fmt not in READERS:
            continue
        below = files.get_file_info(fs.FileSelector(entry.path, recursive=True)) if entry.type == fs.FileType.Directory else [entry]
        found += [SourceFile(source.lower(), fmt, f.path, f.mtime_ns or 0) for f in below
                  if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(found, key=lambda f: (f.changed, f.path))


def _records(path: str, part: SourceFile) -> Iterator[tuple]:
    files, _ = _open(path)
    rows = []
    try:
        with files.open_input_stream(part.path, compression=None) as stream:
            for r in READERS[part.fmt](stream):
                number = r.get("rec_id")
                value = r.get("value")
                rows.append((None if number in (None, "") else int(number), part.source, r.get("kind"),
                             None if value is None else str(value), None))
    except Exception as e:  # noqa: BLE001  (any reader's failure is this source's alone)
        rows = [(None, part.source, None, None, f"{part.path.rsplit('/', 1)[-1]}: {type(e).__name__}: {e}")]
    return iter(rows)


class _Reader(DataSourceReader):
    def __init__(self, path: str, sources: list[str]):
        self.path, self.sources = path, sources

    def partitions(self):
        return source_files(self.path, self.sources) or [SourceFile("", "", "", 0)]

    def read(self, partition):
        return _records(self.path, partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are (time of change, path) of the last file taken; a file that is later given an
    earlier time is not seen."""

    def __init__(self, path: str, sources: list[str]):
        self.path, self.sources = path, sources

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def latestOffset(self):
        files = source_files(self.path, self.sources)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return [f for f in source_files(self.path, self.sources) if low < (f.changed, f.path) <= high]

    def read(self, partition):
        return _records(self.path, partition)

    def commit(self, end):
        pass


class DiscoveryFiles(DataSource):
    """Options ``path`` and ``sources`` (names joined by commas; default all known)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _args(self):
        if "path" not in self.options:
            raise ValueError("option path is missing")
        return self.options["path"], selected_sources((self.options.get("sources") or "").split(","))

    def reader(self, schema):
        return _Reader(*self._args())

    def streamReader(self, schema):
        return _StreamReader(*self._args())


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    errors = rows.filter(F.col("error").isNotNull()).select(
        "source", F.concat(F.lit("source error ("), "source", F.lit("): "), "error").alias("message"))
    return load_discovery(rows.filter(F.col("error").isNull()).drop("error")), errors


def read_discovery_files(spark: SparkSession, path: str, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S6 from the files of the selected sources: the records, and a log line for each file that failed."""
    spark.dataSource.register(DiscoveryFiles)
    return _split(spark.read.format(NAME).option("sources", ",".join(sources or [])).load(path))


def stream_discovery_files(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """S6 as files arrive: a stream of ``rec_id, source, kind, value, error``."""
    spark.dataSource.register(DiscoveryFiles)
    return spark.readStream.format(NAME).option("sources", ",".join(sources or [])).load(path)
