"""Progress of a streaming run as observed metrics, with the run's three callbacks.

Counters are metrics that Spark collects while a micro-batch runs (``DataFrame.observe``),
so progress costs no job of its own.  A listener adds them up and reports them: after each
micro-batch the running counters, the addresses that the batch saw first as a table that
the sink wrote, and log lines.  Each batch's counters are kept in one small file named by
its number, so a restarted run goes on from them and a repeated batch counts once.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from addrgraph.functions.text import page_emails
from addrgraph.operators.extract import split_fetchable

PROGRESS = "epoch long, processed_pages long, failed_pages long, unique_email_count long, total_email_hits long"


@dataclass(frozen=True)
class Progress:
    """Counters up to and including a micro-batch."""

    epoch: int
    processed_pages: int = 0
    failed_pages: int = 0
    unique_email_count: int = 0
    total_email_hits: int = 0


def observed_first_sightings(pages_stream: DataFrame) -> DataFrame:
    """First sighting of each address (email, source_url, page_id) as pages arrive, with the
    metrics ``pages`` (processed, failed, hits) and ``firsts`` (found) observed on the way.

    Pages that are not fetched HTML count as processed and failed and give no address."""
    pages = split_fetchable(pages_stream)
    found = F.when(F.col("ok"), page_emails(F.coalesce("html", F.lit("")))).otherwise(F.array().cast("array<string>"))
    pages = pages.select("page_id", F.col("url").alias("source_url"), "ok", found.alias("found"))
    pages = pages.observe("pages", F.count(F.lit(1)).alias("processed"), F.count_if(~F.col("ok")).alias("failed"),
                          F.sum(F.size("found")).alias("hits"))
    firsts = pages.select(F.explode("found").alias("email"), "source_url", "page_id").dropDuplicates(["email"])
    return firsts.observe("firsts", F.count(F.lit(1)).alias("found"))


class ProgressLog:
    """The counters of each micro-batch, one small JSON file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path, spark._jvm
        self._fs = self._at("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name))

    def put(self, row: Progress) -> None:
        out = self._fs.create(self._at(f"{row.epoch:012d}.json"), True)
        try:
            out.write(bytearray(json.dumps(asdict(row)).encode()))
        finally:
            out.close()

    def before(self, epoch: int) -> Progress:
        """The counters of the last batch before ``epoch``."""
        at = self._at("x").getParent()
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        last = max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit() and int(n[:12]) < epoch), default=None)
        if last is None:
            return Progress(-1)
        stream = self._fs.open(self._at(f"{last:012d}.json"))
        try:
            return Progress(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """Progress after each micro-batch."""
        return self.spark.read.schema(PROGRESS).json(self.path)


class ProgressListener(StreamingQueryListener):
    """Adds up the metrics of the query named ``name`` and calls back.

    ``on_progress(Progress)`` after each micro-batch with pages; ``on_log(text)`` for the
    query's start, failed pages of a batch, and end.  An error in a callback is kept in
    ``error`` and stops no query."""

    def __init__(self, name: str, log: ProgressLog, on_progress: Callable[[Progress], None] | None = None,
                 on_log: Callable[[str], None] | None = None):
        self.name, self.log, self.on_progress, self.on_log = name, log, on_progress, on_log
        self.ids: set[str] = set()
        self.ended, self.error = threading.Event(), None

    def _call(self, f, x):
        if f is not None:
            try:
                f(x)
            except Exception as e:  # noqa: BLE001  (the caller's code)
                self.error = e

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.runId))
            self._call(self.on_log, f"{self.name}: started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or "pages" not in p.observedMetrics:
            return
        pages, firsts = p.observedMetrics["pages"], p.observedMetrics.get("firsts")
        if not pages["processed"]:
            return
        old = self.log.before(p.batchId)
        row = Progress(p.batchId, old.processed_pages + pages["processed"], old.failed_pages + pages["failed"],
                       old.unique_email_count + (firsts["found"] if firsts else 0), old.total_email_hits + (pages["hits"] or 0))
        self.log.put(row)
        self._call(self.on_progress, row)
        if pages["failed"]:
            self._call(self.on_log, f"{self.name}: {pages['failed']} pages of batch {p.batchId} failed")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.ids:
            self._call(self.on_log, f"{self.name}: " + (f"failed: {event.exception}" if event.exception else "ended"))
            self.ended.set()


class ObservedRun:
    """A running query and its listener; ``wait()`` returns the last counters."""

    def __init__(self, spark: SparkSession, query, listener: ProgressListener):
        self.spark, self.query, self.listener = spark, query, listener

    def wait(self, timeout: float = 60) -> Progress:
        """Wait for the query and for the listener's last event; raises what made the query fail."""
        try:
            self.query.awaitTermination()
            if not self.listener.ended.wait(timeout):
                raise TimeoutError("the listener did not hear of the query's end")
        finally:
            self.spark.streams.removeListener(self.listener)
        return self.listener.log.before(1 << 62)


def run_observed(pages_stream: DataFrame, out: str, checkpoint: str, name: str = "run",
                 on_progress: Callable[[Progress], None] | None = None,
                 on_emails: Callable[[DataFrame, int], None] | None = None,
                 on_log: Callable[[str], None] | None = None, available_now: bool = True) -> ObservedRun:
    """K4 by observed metrics.  ``out/emails`` gets each address's first sighting (exactly
    once), ``out/progress`` the counters after each micro-batch.

    With ``on_emails(batch, epoch)`` the batch's first sightings go there, as a DataFrame
    and not through the driver, instead of to ``out/emails``."""
    spark = pages_stream.sparkSession
    listener = ProgressListener(name, ProgressLog(spark, os.path.join(out, "progress")), on_progress, on_log)
    w = (observed_first_sightings(pages_stream).writeStream.queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint))
    w = w.foreachBatch(on_emails) if on_emails else w.format("parquet").option("path", os.path.join(out, "emails"))
    spark.streams.addListener(listener)
    try:
        return ObservedRun(spark, (w.trigger(availableNow=True) if available_now else w).start(), listener)
    except Exception:
        spark.streams.removeListener(listener)
        raise
