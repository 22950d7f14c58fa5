"""Registered streaming jobs: the input table is staged as files in Spark's own
partitioning, replayed as a stream to completion (``availableNow``, micro-batches
bounded in bytes), and the sink is read back.  Each equals its batch twin.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrgraph.operators.eventlog import LOG_KEEP_LINES, LOG_LIMIT_LINES
from addrgraph.plans import oracle_sql as O
from addrgraph.operators import enrich as E
from addrgraph.plans.fixtures import DISCOVERY_TARGET_DOMAIN, fixture
from addrgraph.plans.queries import source_folder
from addrgraph.sources.discovery import load_discovery
from addrgraph.sources.discovery_files import stream_discovery_files
from addrgraph.session import checkpoint_dir
from addrgraph.sources.eventlog import parse_event_lines
from addrgraph.streaming import jobs as K
from addrgraph.streaming.progress import run_observed


# Input of one micro-batch.
MICRO_BATCH_BYTES = 1 << 30
# Micro-batches in which a log is replayed.
REPLAY_BATCHES = 3


def _stage(spark: SparkSession, df: DataFrame, name: str) -> tuple[str, str]:
    """Write ``df`` as several Parquet files on shared storage; return (data, work) folders."""
    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), name)
    data = os.path.join(work, "input")
    df.write.mode("overwrite").parquet(data)
    return data, work


def _replay(spark: SparkSession, data: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", MICRO_BATCH_BYTES).parquet(data)


def _await(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream_email_hits(spark: SparkSession, d: str) -> DataFrame:
    site = fixture(spark, d, "site")
    data, work = _stage(spark, site, "k1")
    hits = K.stream_email_hits(_replay(spark, data, site.schema))
    q = (hits.writeStream.format("parquet").option("path", os.path.join(work, "out"))
         .option("checkpointLocation", os.path.join(work, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(os.path.join(work, "out")).select("page_id", "source_url", "email")


def stream_email_report(spark: SparkSession, d: str) -> DataFrame:
    hits = fixture(spark, d, "hits")
    data, work = _stage(spark, hits, "k2")
    _await(K.run_email_report(_replay(spark, data, hits.schema), os.path.join(work, "out"),
                              os.path.join(work, "ckpt")))
    return K.read_report(spark, os.path.join(work, "out")).select("email", "hits", "first_seen", "last_seen",
                                                                  "source_url")


def stream_unique_emails(spark: SparkSession, d: str) -> DataFrame:
    hits = fixture(spark, d, "hits")
    data, work = _stage(spark, hits, "k3")
    u = K.stream_unique_emails(_replay(spark, data, hits.schema)).select("email")
    q = (u.writeStream.format("parquet").option("path", os.path.join(work, "out"))
         .option("checkpointLocation", os.path.join(work, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(os.path.join(work, "out"))


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    site = fixture(spark, d, "site")
    data, work = _stage(spark, site, "k4")
    _await(K.run_progress(_replay(spark, data, site.schema), os.path.join(work, "out"), os.path.join(work, "ckpt")))
    return K.read_progress(spark, os.path.join(work, "out", "progress")).select(
        "processed_pages", "failed_pages", "unique_email_count", "total_email_hits")


def stream_event_demux(spark: SparkSession, d: str) -> DataFrame:
    lines = fixture(spark, d, "event_lines")
    data, work = _stage(spark, lines, "k5")
    out = os.path.join(work, "out")
    _await(K.run_event_demux(_replay(spark, data, lines.schema), out, os.path.join(work, "ckpt")))
    parts = [spark.read.parquet(os.path.join(out, k)) for k in K.EVENT_KINDS
             if K._exists(spark, os.path.join(out, k))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.drop("line", "epoch")
            .withColumn("table", F.when(F.col("kind") == "unparsed", "log").otherwise(F.col("kind"))))


def _replay_runs(spark: SparkSession, d: str, name: str):
    """The log of several runs as a stream of typed events in a few micro-batches, in order of line."""
    lines = fixture(spark, d, "run_lines")
    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), name)
    data = os.path.join(work, "input")
    for part in range(REPLAY_BATCHES):
        # consecutive lines of the log; a file source takes older files first
        size = F.expr("(select count(*) from events)") / REPLAY_BATCHES
        mine = lines.where(F.least(F.floor(F.col("line_no") / size), F.lit(REPLAY_BATCHES - 1)) == part)
        mine.coalesce(1).write.mode("append").parquet(data)
    src = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(data)
    return parse_event_lines(src, keep=["run_id"]), work


def stream_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Live W2 over several micro-batches: carried counters of interleaved runs."""
    events, work = _replay_runs(spark, d, "w2")
    out = os.path.join(work, "out")
    _await(K.run_carry_forward(events, out, os.path.join(work, "ckpt")))
    rows = spark.read.parquet(out)
    return rows.select(F.col("run").cast("long").alias("run_id"), *[c for c in rows.columns if c != "run"])


def stream_retained_log(spark: SparkSession, d: str) -> DataFrame:
    """Live L6: the log that each run shows after all appends, line by line."""
    events, work = _replay_runs(spark, d, "l6")
    out = os.path.join(work, "out")
    _await(K.run_retained_log(events, out, os.path.join(work, "ckpt")))
    shown = K.KeyedTable(spark, out).read()
    return shown.select(F.col("run").cast("long").alias("run_id"), "appended", "length", F.inline("lines"))


def stream_progress_observed(spark: SparkSession, d: str) -> DataFrame:
    """K4 by observed metrics: the last counters that the listener kept."""
    site = fixture(spark, d, "site")
    data, work = _stage(spark, site, "k4o")
    run = run_observed(_replay(spark, data, site.schema), os.path.join(work, "out"), os.path.join(work, "ckpt"),
                       name=os.path.basename(work))
    run.wait()
    last = F.max_by(F.struct("processed_pages", "failed_pages", "unique_email_count", "total_email_hits"), "epoch")
    return run.listener.log.read().agg(last.alias("r")).select("r.*")


def stream_discovery(spark: SparkSession, d: str) -> DataFrame:
    """S6 as a stream of source files into the enrichment rules: distinct accepted values (A4)."""
    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), "s6")
    rows = stream_discovery_files(spark, source_folder(spark, d)).filter("error is null").drop("error")
    accepted = E.accepted_records(load_discovery(rows), DISCOVERY_TARGET_DOMAIN).select("kind", "value")
    q = (accepted.dropDuplicates(["kind", "value"]).writeStream.format("parquet").option("path", os.path.join(work, "out"))
         .option("checkpointLocation", os.path.join(work, "ckpt")).outputMode("append").trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(os.path.join(work, "out"))


STREAM_QUERIES = {
    "stream_discovery": stream_discovery,
    "stream_progress_observed": stream_progress_observed,
    "stream_carry_forward": stream_carry_forward,
    "stream_retained_log": stream_retained_log,
    "stream_email_hits": stream_email_hits,
    "stream_email_report": stream_email_report,
    "stream_unique_emails": stream_unique_emails,
    "stream_progress": stream_progress,
    "stream_event_demux": stream_event_demux,
}


def stream_oracles() -> dict[str, str]:
    o = O.oracle_sql()
    summary = o["crawl_summary"].replace(",\n  0.0::double as duration_seconds", "")
    out = {
        "stream_email_hits": o["extract_emails_site"],
        "stream_email_report": o["email_report"],
        "stream_discovery": o["enrichment_sets"],
        "stream_carry_forward": o["carry_forward_runs"],
        "stream_retained_log": "with " + O.event_ctes("run_lines", "run_id") + f""",
m as (select run_id, line_no, '[Scrapy] ' || t as message, row_number() over (partition by run_id order by line_no) as nth,
  count(*) over (partition by run_id) as appended from (
    select *, case when kind = 'unparsed' then line when kind = 'log' and length(trim_ws(message)) > 0 then message end as t from ev)
  where t is not null)
select run_id, appended, length::int as length, line_no, message
from (select *, case when appended <= {LOG_LIMIT_LINES} then appended
  else {LOG_KEEP_LINES} + (appended - {LOG_LIMIT_LINES} - 1) % ({LOG_LIMIT_LINES} + 1 - {LOG_KEEP_LINES}) end as length from m)
where nth > appended - length""",
        "stream_unique_emails": "with " + O.fx("hits") + "\nselect distinct email from hits",
        "stream_progress": summary,
        "stream_progress_observed": summary,
        "stream_event_demux": "with " + O.event_ctes() + """
select line_no, kind, email, source_url, current_url, message, reason, processed_pages, failed_pages,
  unique_email_count, total_email_hits, queue_length, duration_seconds,
  case when kind = 'unparsed' then 'log' else kind end as "table"
from ev where kind in ('email', 'progress', 'log', 'summary', 'unparsed')""",
    }
    return {name: O._expand_trims(sql) for name, sql in out.items()}
