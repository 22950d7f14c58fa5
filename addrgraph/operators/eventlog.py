"""Operators over the typed event log (see ``sources.eventlog``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrgraph.functions.common import strip_ws
from addrgraph.plans.prefix import running_scan

COUNTERS = ["processed_pages", "failed_pages", "unique_email_count", "total_email_hits"]

# Log retention (keep the last N lines once above the limit) and
# the error-tail length and separator.
LOG_LIMIT_LINES = 1200
LOG_KEEP_LINES = 1000
ERROR_TAIL_LINES = 20
ERROR_TAIL_SEPARATOR = " | "
LOG_PREFIX = "[Scrapy] "


def drop_incomplete_email_events(events: DataFrame) -> DataFrame:
    """F8.  ``email`` events with a non-blank address and source URL."""
    return (events.filter(F.col("kind") == "email")
            .filter((F.length(strip_ws("email")) > 0) & (F.length(strip_ws("source_url")) > 0))
            .select("line_no", "email", "source_url"))


def carry_forward(events: DataFrame, rows_per_bucket: int | None = None, run_col: str | None = None) -> DataFrame:
    """W2.  One row per ``progress`` event with its counters carried forward.

    A counter that is missing or unreadable keeps the last value seen in any
    progress or summary event of its run before it (0 at the start);
    ``queue_length`` does not carry (missing = 0).  ``run_col`` names the run of
    a line where a log holds several, which may be interleaved; a null run is one
    like any other.  The carry is a distributed prefix scan that starts anew with
    each run, and a run of any length is spread over many ranges.
    """
    run = [run_col] if run_col else []
    ev = events.filter(F.col("kind").isin("progress", "summary")).select(
        *run, "line_no", "kind", *COUNTERS, "queue_length", "current_url")
    scanned = running_scan(ev, "line_no", lasts={f"__c_{c}": F.col(c) for c in COUNTERS},
                           rows_per_bucket=rows_per_bucket, segment=run_col)
    return (scanned.filter(F.col("kind") == "progress")
            .select(*run, "line_no",
                    *[F.coalesce(F.col(f"__c_{c}"), F.lit(0)).alias(c) for c in COUNTERS],
                    F.coalesce("queue_length", F.lit(0)).alias("queue_length"),
                    F.col("current_url")))


def event_log_summary(events: DataFrame, run_col: str | None = None) -> DataFrame:
    """A6.  Final counters after the whole log: the last readable value of each
    (progress and summary events alike), 0 when none; duration from the last
    summary event (0 when it is not positive or no summary was seen).

    With ``run_col`` one row per run that has a line of any kind, so a run that
    failed before its first progress line is there with zeros (partial aggregates:
    a run that holds a third of all lines is combined where they are read)."""
    counts = F.col("kind").isin("progress", "summary")
    last = [F.coalesce(F.max_by(c, F.when(counts & F.col(c).isNotNull(), F.col("line_no"))), F.lit(0)).alias(c)
            for c in COUNTERS]
    is_sum = F.col("kind") == "summary"
    dur = F.max_by(F.coalesce("duration_seconds", F.lit(0.0)), F.when(is_sum, F.col("line_no")))
    ev = events.groupBy(run_col) if run_col else events.filter(counts)
    return ev.agg(*last,
                  F.coalesce(F.greatest(dur, F.lit(0.0)), F.lit(0.0)).alias("duration_seconds"),
                  (F.count_if(is_sum) > 0).alias("saw_summary"))


def log_messages(events: DataFrame, keep: list | None = None) -> DataFrame:
    """Log lines of the run: ``log`` events with a non-blank message, and lines
    that were not JSON, each prefixed as the consumer shows them.  ``keep`` has
    columns to take along."""
    keep = keep or []
    msg = (F.when(F.col("kind") == "unparsed", F.col("line"))
           .when((F.col("kind") == "log") & (F.length(strip_ws("message")) > 0), F.col("message")))
    rows = events.select(*keep, "line_no", msg.alias("__m")).filter(F.col("__m").isNotNull())
    return rows.withColumn("message", F.concat(F.lit(LOG_PREFIX), F.col("__m"))).drop("__m")


def keep_last_lines(log: DataFrame, limit: int = LOG_LIMIT_LINES, keep: int = LOG_KEEP_LINES) -> DataFrame:
    """L6.  Retention: above ``limit`` lines keep only the last ``keep``.

    The retention is the feature: a top-k by ``line_no`` (TakeOrderedAndProject,
    at most ``keep`` rows per task), decided by one count.
    """
    if log.count() <= limit:
        return log
    return log.orderBy(F.col("line_no").desc()).limit(keep)


def error_tail(lines: DataFrame, n: int = ERROR_TAIL_LINES, text_col: str = "message") -> DataFrame:
    """L6 (error text).  The last ``n`` non-blank lines, trimmed, joined by `` | ``."""
    top = (lines.filter(F.length(strip_ws(text_col)) > 0)
           .orderBy(F.col("line_no").desc()).limit(n))
    return top.agg(F.coalesce(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", strip_ws(text_col).alias("t")))),
                    lambda s: s["t"]), ERROR_TAIL_SEPARATOR), F.lit("")).alias("error_tail"))
