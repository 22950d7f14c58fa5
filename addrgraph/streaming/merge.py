"""A table that micro-batches update by key.

Rows stand in a fixed number of hash buckets.  A batch rewrites the buckets that it touches,
under its epoch, and then publishes a manifest (bucket, folder) by renaming one small file;
readers use the newest manifest.  An epoch that is replayed finds its manifest and does
nothing; one that failed half-way is written again.  What a read costs depends on the table,
not on the number of epochs.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "__bucket"


class KeyedTable:
    """``path`` holds ``data/<epoch>/__bucket=<b>`` and ``manifests/<epoch>``.

    The first batch with rows fixes the columns, the keys and the number of buckets, which the
    manifests carry on.  ``keep`` manifests stay readable; data that none of them names is
    deleted.  Keys may be null: nulls are one key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int | None = None, keep: int = 2):
        self.spark, self.path, self.keys, self.keep = spark, path, list(keys or []), keep
        self.wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._jvm = spark._jvm
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))

    def epochs(self) -> list[int]:
        """Published epochs, oldest first."""
        top = self._at("manifests")
        if not self._fs.exists(top):
            return []
        return sorted(int(n) for s in self._fs.listStatus(top) if (n := s.getPath().getName()).isdigit())

    def _manifest(self, epoch: int | None) -> dict:
        if epoch is None:
            return {"buckets": self.wanted, "keys": self.keys, "folders": {}}
        stream = self._fs.open(self._at("manifests", f"{epoch:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self) -> int | None:
        return max(self.epochs(), default=None)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [os.path.join(self.path, f) for b, f in sorted(manifest["folders"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as last published; there must have been a batch with rows."""
        newest = self._newest()
        if newest is None:
            raise ValueError(f"nothing was published at {self.path}")
        return self._rows(self._manifest(newest))

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Replace or add the rows of ``batch`` by key; one row per key in a batch."""
        newest = self._newest()
        if newest is not None and epoch <= newest:
            return  # a replay
        manifest = {"schema": batch.schema.jsonValue()} | self._manifest(newest)
        schema, keys = StructType.fromJson(manifest["schema"]), manifest["keys"]
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(manifest["buckets"])).cast("int")
        batch = batch.select([F.col(f.name).cast(f.dataType) for f in schema]).withColumn(_BUCKET, bucket).persist()
        try:
            touched = [r[0] for r in batch.select(_BUCKET).distinct().collect()]  # numbers below the bucket count
            if not touched:
                return
            old = self._rows(manifest, touched).withColumn(_BUCKET, bucket).alias("old")
            on = F.col(f"old.{_BUCKET}") == F.col(f"new.{_BUCKET}")
            for k in keys:
                on = on & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
            rest = old.join(batch.select(*keys, _BUCKET).alias("new"), on, "left_anti")
            folder = os.path.join("data", f"{epoch:012d}")
            (rest.unionByName(batch).repartition(len(touched), _BUCKET).write.mode("overwrite")
             .partitionBy(_BUCKET).parquet(os.path.join(self.path, folder)))
        finally:
            batch.unpersist()
        folders = manifest["folders"] | {str(b): os.path.join(folder, f"{_BUCKET}={b}") for b in touched}
        self._publish(manifest | {"folders": folders}, epoch)
        self._clean()

    def _publish(self, manifest: dict, epoch: int) -> None:
        name = f"{epoch:012d}"
        draft = self._at("drafts", name)
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._at("manifests"))
        if not self._fs.rename(draft, self._at("manifests", name)):
            raise RuntimeError(f"epoch {epoch} of {self.path} was not published")

    def _clean(self) -> None:
        epochs = self.epochs()
        named = {f for e in epochs[-self.keep:] for f in self._manifest(e)["folders"].values()}
        for e in epochs[:-self.keep]:
            for folder in set(self._manifest(e)["folders"].values()) - named:
                self._fs.delete(self._at(folder), True)
            self._fs.delete(self._at("manifests", f"{e:012d}"), False)
