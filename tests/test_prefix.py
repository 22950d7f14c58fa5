"""The bucketed prefix scan equals a plain global window, with many buckets."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from addrgraph.plans.prefix import global_rank, running_scan


def test_running_scan_many_buckets(spark):
    df = spark.range(0, 5000).select((F.col("id") * 3 + 1).alias("k"),
                                      (F.col("id") % 7).alias("v"),
                                      F.when(F.col("id") % 5 == 0, F.col("id")).alias("x"))
    got = running_scan(df, "k", sums={"s": F.col("v")}, lasts={"l": F.col("x")}, rows_per_bucket=300)
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", F.sum("v").over(w).alias("s"), F.last("x", ignorenulls=True).over(w).alias("l"))
    a = sorted(tuple(r) for r in got.select("k", "s", "l").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b
    assert got.select("k").distinct().count() == 5000


@pytest.mark.parametrize("buckets", [500, 5000])
def test_running_scan_very_many_buckets(spark, buckets):
    n = 20_000
    df = spark.range(n).select((F.col("id") * 3 + 1).alias("k"), (F.col("id") % 7).alias("v"),
                               F.when(F.col("id") % 5 == 0, F.col("id")).alias("x"))
    got = running_scan(df, "k", sums={"s": F.col("v")}, lasts={"l": F.col("x")}, rows_per_bucket=n // buckets)
    want, total = {}, 0
    for i in range(n):
        total += i % 7
        want[3 * i + 1] = (total, i - i % 5)
    assert {r["k"]: (r["s"], r["l"]) for r in got.collect()} == want


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = global_rank(df, ["k"], "r", rows_per_bucket=90).collect()
    assert all(r["k"] == r["r"] for r in got) and len(got) == 1000


@pytest.mark.parametrize("rows_per_bucket", [17, 250, None])
def test_segmented_scan_is_a_window_by_segment(spark, rows_per_bucket):
    """One segment holds a third of all rows, many hold one, one is null."""
    seg = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.col("id")).when(F.col("id") % 7 != 2, F.col("id") % 5)
    df = spark.range(4000).select(((F.col("id") * 1361) % 4001).alias("k"), seg.alias("run"), (F.col("id") % 7).alias("v"),
                                  F.when(F.col("id") % 11 == 0, F.col("id")).alias("x"))
    got = running_scan(df, "k", {"s": F.col("v")}, {"l": F.col("x")}, rows_per_bucket, segment="run")
    w = Window.partitionBy("run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.last("x", ignorenulls=True).over(w).alias("l"))
    key = lambda r: (r["run"] is not None, r["run"] or 0, r["k"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)
    assert len({key(r) for r in got.collect()}) == 4000


def test_segmented_scan_spreads_a_run(spark):
    """A run that holds all rows goes through many ranges."""
    from addrgraph.plans.prefix import in_ranges

    df = spark.range(3000).select(F.lit("r").alias("run"), F.col("id").alias("k"))
    sizes = [r["count"] for r in in_ranges(df, ["run", "k"], 300).groupBy("__bucket").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 900


def test_segmented_scan_of_nothing(spark):
    df = spark.createDataFrame([], "run string, k long")
    assert running_scan(df, "k", {"n": F.lit(1)}, segment="run").count() == 0
