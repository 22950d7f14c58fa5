"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

def get_spark(master: str | None = None, app: str = "addrgraph",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster, ``master`` is left to ``spark-submit``; the defaults here
    only pin what the operators rely on: UTC session time, AQE with skew-join
    splitting, and no web UI.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor.
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    A cluster names a shared folder in ``spark.checkpoint.dir`` (or the
    context already has one); it is used as is.  Only when neither is set and
    the master is local (tests) is a fresh folder created and registered with the
    context; elsewhere a folder of one machine would lose data, so that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="addrgraph-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def bucketed_table(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table bucketed by ``key`` under the shared checkpoint
    folder; returns it read back and its catalog name, which the caller drops.

    Lineage is cut and the data survives executor loss.  The bucketing is
    recorded in the catalog, so joins and aggregates on ``key`` read this side
    without a shuffle (with or without AQE).  The data is hash-partitioned by
    the key first, so each task writes one file per bucket, not one per task
    and bucket.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, table)
    with shuffles_freed(spark):
        df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table), table


class BucketedLog:
    """A table bucketed by ``key`` that grows by appends; the folder stays when the catalog entry is dropped.

    Joins and aggregates on ``key`` read all that was appended without a shuffle.  Rows
    should come hash-partitioned by the key, as a join or aggregate on it leaves them: then
    an append writes a file per bucket."""

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.key, self.name = spark, key, f"{name}_{uuid.uuid4().hex[:12]}"
        self.path = scratch_path(spark, self.name)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> None:
        with shuffles_freed(self.spark):
            (df.write.mode("append").bucketBy(self.buckets, self.key).format("parquet").option("path", self.path)
             .saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


_SCOPE: ContextVar[str | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, in the open ``scratch`` scope if there is one."""
    base = _SCOPE.get() or os.path.join(checkpoint_dir(spark), "tables")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage is cut, the data survives executor loss, and later joins
    see its real size."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executions started inside remove their shuffle files when they end, so that a job of many
    written tables holds the shuffles of one at a time.  A frame executed again shuffles again."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope for intermediate tables: what is written inside is deleted at its end.

    Yields ``keep(df, name)``, which writes a table that stays and reads it back; only
    such tables may be used after the scope.
    """
    outer, path = _SCOPE.get(), scratch_path(spark, name)

    def keep(df: DataFrame, kept: str) -> DataFrame:
        inner = _SCOPE.set(outer)
        try:
            return write_through(df, kept)
        finally:
            _SCOPE.reset(inner)

    token = _SCOPE.set(path)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)
