"""Running totals, carried values and ranks over an order, without one task per order.

A window ``ORDER BY x ROWS UNBOUNDED PRECEDING`` moves every row of its partition to a
single task: all rows without ``PARTITION BY``, a whole run with ``PARTITION BY run``.
Here the rows are range-partitioned by (segment, order) and written once with the number
of their range.  The scan runs per range and segment in parallel.  Only the first segment
of a range can go on from the range before, and only the last one goes on into the next;
so two rows a range (a bounded table) are scanned across the ranges and joined back as
carries, which reset where a segment begins.

Both supported scans are associative: sums, and "last non-null value".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.session import write_through


def in_ranges(df: DataFrame, order: list[str], rows_per_bucket: int | None = None, stored: bool = False) -> DataFrame:
    """``df`` written in ranges of ``order`` with the range's number as ``__bucket``.

    As many ranges as shuffle partitions, or as ``rows_per_bucket`` asks.  Finding the
    bounds of the ranges reads the input once more, so it is written first unless the
    caller says that it is ``stored``.
    """
    spark = df.sparkSession
    rows = df if stored else write_through(df, "scan_rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows_per_bucket is not None:
        n = max(1, math.ceil(rows.count() / rows_per_bucket))
    return write_through(rows.repartitionByRange(n, *order).withColumn("__bucket", F.spark_partition_id()), "scan_ranges")


def running_scan(df: DataFrame, order_col: str | list[str], sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None, rows_per_bucket: int | None = None,
                 segment: str | list[str] | None = None, stored: bool = False) -> DataFrame:
    """Add running sums and last-non-null values ordered by ``order_col`` within each ``segment``.

    ``order_col`` must be unique within its segment (no segment: all rows are one; a null
    segment is one like any other).  ``sums`` maps output name to the per-row amount;
    ``lasts`` maps output name to the per-row value whose latest non-null occurrence (up to
    and including the row) is carried.  ``stored``: ``df`` reads files, so it needs no
    writing of its own before its ranges are found.
    """
    sums, lasts = sums or {}, lasts or {}
    if not sums and not lasts:
        return df
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    seg = [segment] if isinstance(segment, str) else list(segment or [])
    tmp = {f"__s_{k}": v for k, v in sums.items()} | {f"__l_{k}": v for k, v in lasts.items()}
    base = in_ranges(df.select("*", *[v.alias(k) for k, v in tmp.items()]), [*seg, *order], rows_per_bucket, stored)

    w_in = (Window.partitionBy("__bucket", *seg).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = base.select("*", *[F.sum(f"__s_{k}").over(w_in).alias(f"__rs_{k}") for k in sums],
                        *[F.last(f"__l_{k}", ignorenulls=True).over(w_in).alias(f"__rl_{k}") for k in lasts])

    # What a range hands on: totals and last non-null values of its first and its last segment.
    place = F.struct(*order)
    aggs = [F.sum(f"__s_{k}").alias(f"__ts_{k}") for k in sums]
    aggs += [F.max_by(f"__l_{k}", F.when(F.col(f"__l_{k}").isNotNull(), place)).alias(f"__tl_{k}") for k in lasts]
    edge = base
    if seg:
        whole = F.struct(*seg)
        ends = base.groupBy(F.col("__bucket").alias("__b")).agg(F.min(whole).alias("__first"), F.max(whole).alias("__end"))
        # one row per range: a bounded broadcast
        edge = base.join(F.broadcast(ends), F.col("__bucket") == F.col("__b")).where(
            whole.eqNullSafe(F.col("__first")) | whole.eqNullSafe(F.col("__end")))
    totals = edge.groupBy("__bucket", *seg).agg(*aggs)
    w_b = Window.partitionBy(*seg) if seg else Window.partitionBy()
    w_b = w_b.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        F.col("__bucket").alias("__b"), *[F.col(c).alias(f"__seg_{c}") for c in seg],
        *[F.coalesce(F.sum(f"__ts_{k}").over(w_b), F.lit(0)).alias(f"__os_{k}") for k in sums],
        *[F.last(f"__tl_{k}", ignorenulls=True).over(w_b).alias(f"__ol_{k}") for k in lasts],
    )
    # at most two rows per range: a bounded broadcast
    same = F.col("__bucket") == F.col("__b")
    for c in seg:
        same = same & F.col(c).eqNullSafe(F.col(f"__seg_{c}"))
    out = inner.join(F.broadcast(carries), same, "left")
    return out.select(*df.columns,
                      *[(F.col(f"__rs_{k}") + F.coalesce(F.col(f"__os_{k}"), F.lit(0))).alias(k) for k in sums],
                      *[F.coalesce(F.col(f"__rl_{k}"), F.col(f"__ol_{k}")).alias(k) for k in lasts])


def global_rank(df: DataFrame, order: list[str], name: str, rows_per_bucket: int | None = None,
                stored: bool = False) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of ``order`` (unique), over all rows."""
    base = in_ranges(df, order, rows_per_bucket, stored)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).select(
        "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return (base.withColumn("__in", inside).join(F.broadcast(offsets), "__bucket")  # one row per range
            .select(*df.columns, (F.col("__in") + F.col("__before")).cast("long").alias(name)))
