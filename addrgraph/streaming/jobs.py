"""Structured Streaming variants of the operators (K1-K5).

The batch operators are reused unchanged on streaming DataFrames where they
are stateless (K1, S4).  Stateful ones use Spark's state store (K2, K3) or an
incremental ``foreachBatch`` job that keeps its state as tables (K4, K5).
Sinks write under a caller-given folder on shared storage, with a checkpoint
per query, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrgraph.functions.text import page_emails
from addrgraph.operators.extract import extract_emails, split_fetchable
from addrgraph.sources.eventlog import parse_event_lines
from addrgraph.streaming.merge import KeyedTable
from addrgraph.streaming.state import start_keyed, stream_carry_forward, stream_retained_log

EVENT_KINDS = ["email", "progress", "log", "summary"]


def stream_email_hits(pages_stream: DataFrame, decode: bool = True, mode: str = "basic") -> DataFrame:
    """K1.  Addresses as pages arrive (stateless, append)."""
    ok = split_fetchable(pages_stream).filter("ok")
    return extract_emails(ok, decode=decode, mode=mode)


def stream_email_report(hits_stream: DataFrame) -> DataFrame:
    """K2.  Per-address count / first / last / first source, as a stateful
    aggregate (update or complete mode)."""
    first = F.struct(F.col("seen_at").isNotNull(), F.col("seen_at"), F.col("page_id"))
    return hits_stream.groupBy("email").agg(
        F.count(F.lit(1)).alias("hits"), F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"), F.min_by("source_url", first).alias("source_url"))


def stream_unique_emails(hits_stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """K3.  First sighting of each address.

    Without a watermark the state keeps every address (the reference's
    semantics).  With ``watermark`` (e.g. ``"1 day"``) the state is bounded,
    and an address seen again after the watermark passed is reported again.
    """
    if watermark:
        # Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read in the
        # session time zone (UTC).
        if hits_stream.schema["seen_at"].dataType.typeName() == "timestamp_ntz":
            hits_stream = hits_stream.withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        return (hits_stream.withWatermark("seen_at", watermark)
                .dropDuplicatesWithinWatermark(["email"]))
    return hits_stream.dropDuplicates(["email"])


def read_report(spark: SparkSession, base: str) -> DataFrame:
    """Current report of a K2 sink."""
    return KeyedTable(spark, base).read()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_progress(spark: SparkSession, base: str) -> DataFrame:
    """Latest progress row of a K4 sink (one row)."""
    log = spark.read.parquet(base)
    cols = [c for c in log.columns if c != "epoch"]
    return log.agg(F.max_by(F.struct(*cols), F.col("epoch")).alias("r")).select("r.*")


def run_email_report(hits_stream: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                     buckets: int | None = None):
    """K2 sink: update mode; a micro-batch merges its changed rows into a table keyed by
    address and rewrites only the hash buckets that hold them (``streaming.merge``)."""
    table = KeyedTable(hits_stream.sparkSession, out, ["email"], buckets)
    w = (stream_email_report(hits_stream).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(table.merge))
    return (w.trigger(availableNow=True) if available_now else w).start()


def run_carry_forward(events_stream: DataFrame, out: str, checkpoint: str, run_col: str = "run_id", available_now: bool = True):
    """Live W2: progress rows with carried counters, appended as Parquet (exactly once)."""
    w = (stream_carry_forward(events_stream, run_col).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w
    return start_keyed(events_stream.sparkSession, w.start)


def run_retained_log(events_stream: DataFrame, out: str, checkpoint: str, run_col: str = "run_id", available_now: bool = True):
    """Live L6: the log that each run shows, in a table keyed by run."""
    spark = events_stream.sparkSession
    table = KeyedTable(spark, out, ["run"])
    w = (stream_retained_log(events_stream, run_col).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(table.merge))
    w = w.trigger(availableNow=True) if available_now else w
    return start_keyed(spark, w.start)


def run_progress(pages_stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """K4.  Running counters per micro-batch: processed, failed, unique
    addresses so far, total hits so far.

    Totals and first sightings are one stateful aggregate: a group for all pages
    and one for each address, with the times of the first and the last batch
    that held it.  A batch sees only the groups it changed; an address is new if
    its first batch is this one.  Only the running count of addresses comes from
    the row of the epoch before.
    """
    spark = pages_stream.sparkSession
    progress = os.path.join(out, "progress")
    pages = split_fetchable(pages_stream)
    emails = F.when(F.col("ok"), page_emails(F.coalesce("html", F.lit("")))).otherwise(F.array().cast("array<string>"))
    pages = pages.select("ok", emails.alias("emails"))
    page = F.struct(F.lit("page").alias("kind"), F.lit("").alias("key"), F.col("ok"), F.size("emails").alias("found"))
    each = F.transform("emails", lambda e: F.struct(
        F.lit("address").alias("kind"), e.alias("key"), F.lit(True).alias("ok"), F.lit(0).alias("found")))
    rows = pages.select(F.inline(F.concat(F.array(page), each)))
    rows = rows.withColumn("at", F.current_timestamp())  # one value in a micro-batch
    groups = rows.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.sum("found").alias("found"),
        F.min("at").alias("first"), F.max("at").alias("last"))

    def step(batch: DataFrame, epoch: int) -> None:
        is_page = F.col("kind") == "page"
        now_row = batch.agg(
            F.max(F.when(is_page, F.col("n"))).alias("processed_pages"), F.max(F.when(is_page, F.col("failed"))).alias("failed_pages"),
            F.count_if(~is_page & (F.col("first") == F.col("last"))).alias("new"),
            F.max(F.when(is_page, F.col("found"))).alias("total_email_hits"))
        before = os.path.join(progress, f"epoch={epoch - 1:012d}")
        prev = spark.read.parquet(before).first() if epoch and _exists(spark, before) else None
        base = prev.asDict() if prev else dict.fromkeys(("processed_pages", "failed_pages", "unique_email_count", "total_email_hits"), 0)
        now_row.select(
            *[F.coalesce(F.col(c), F.lit(base[c])).cast("long").alias(c) for c in ("processed_pages", "failed_pages")],
            (F.col("new") + base["unique_email_count"]).alias("unique_email_count"),
            F.coalesce("total_email_hits", F.lit(base["total_email_hits"])).cast("long").alias("total_email_hits"),
        ).write.mode("overwrite").parquet(os.path.join(progress, f"epoch={epoch:012d}"))

    w = groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (w.trigger(availableNow=True) if available_now else w).start()


def run_event_demux(lines_stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """K5.  Split an NDJSON line stream into email / progress / log / summary
    tables (lines that are not JSON go to ``log``), one cached batch each."""

    def step(batch: DataFrame, epoch: int) -> None:
        # One folder per epoch and table, overwritten on replay: exactly once.
        ev = parse_event_lines(batch).persist()
        for kind in EVENT_KINDS:
            kinds = [kind, "unparsed"] if kind == "log" else [kind]
            (ev.filter(F.col("kind").isin(kinds)).write.mode("overwrite")
             .parquet(os.path.join(out, kind, f"epoch={epoch:012d}")))
        ev.unpersist()

    w = lines_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (w.trigger(availableNow=True) if available_now else w).start()


def new_run_folder(base: str, name: str) -> str:
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
