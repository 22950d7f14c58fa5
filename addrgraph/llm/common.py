"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrgraph.session import write_through

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: the blank and the characters 09 to 0D.
WORD = "[^\\x20\\x09-\\x0D]+"

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors don't
    recompute it, and row numbers given before stay as they are."""
    return write_through(df, f"llm-{name}")


@contextmanager
def text_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Executions started inside hand Python functions so many rows at a time: a batch of whole
    texts stands in the executor's memory several times over, on both sides."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def memory_returned() -> None:
    """Give back what the worker's earlier tasks have freed but the allocators keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc: nothing to trim
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _state(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the edges: equal when nothing changed."""
    digest = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of ``edges`` (columns a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    round is two grouped minimums and two joins on the edge table, which is
    written to the shared folder; the number of rounds grows with the logarithm
    of the longest path.  A hub's neighbours meet in the join, not in one list.
    Returns (node, component), nodes with an edge only.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where("u <> v").distinct(), "edges")
    now = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (e.select(F.col("v").alias("u"), F.col("u").alias("v"))
                 .join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # every larger neighbour points at the minimum; the node keeps its own link to it
        large = large.union(low.where("m <> u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        new = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .where("u <> v").distinct(), "edges")
        old, now = now, _state(new)
        e = new
        if now == old:
            break
    # now every node points at its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of an ASCII text (it has no such function)."""
    letters = f"list_transform(string_split({text}, ''), lambda ch: cast(ascii(ch) as bigint))"
    eight = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {letters}), lambda c, x: {eight}), 4294967295)"
