"""Per-address report, run summary, running progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrgraph.plans.prefix import running_scan
from addrgraph.session import write_through

REPORT_COLUMNS = ["email", "hits", "first_seen", "last_seen", "source_url"]


def _sighting_order():
    """Order of sightings: untimed rows (enrichment) first, then time, then page."""
    return F.struct(F.col("seen_at").isNotNull(), F.col("seen_at"), F.col("page_id"))


def email_report(hits: DataFrame) -> DataFrame:
    """A1 (= J4 in batch).  Per address: hits (pages it was seen on), first and
    last sighting time, and the source URL of the first sighting.

    One aggregate with a map-side partial step (sorted, as the first source is a
    text): a hot address is
    combined inside each task before the shuffle, so its row count never
    reaches a single reducer.
    """
    if "seen_at" not in hits.columns:
        hits = hits.withColumn("seen_at", F.lit(None).cast("timestamp_ntz"))
    return hits.groupBy("email").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.min_by("source_url", _sighting_order()).alias("source_url"),
    )


def document_email_report(hits: DataFrame) -> DataFrame:
    """A1 over an untimed corpus: pages count, first and last page id, first source."""
    return hits.groupBy("email").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("page_id").alias("first_page_id"),
        F.max("page_id").alias("last_page_id"),
        F.min_by("source_url", "page_id").alias("source_url"),
    )


def order_report(report: DataFrame) -> DataFrame:
    """L1.  By address ignoring case (range-partitioned sort)."""
    return report.orderBy(F.lower("email"), "email")


def unique_emails(hits: DataFrame) -> DataFrame:
    """D2.  Distinct addresses (partial + final aggregate)."""
    return hits.select("email").distinct()


#: Logarithm of a sketch's registers, and the relative error that three in 370 counts exceed.
SKETCH_LG = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_LG / 2)


def email_sketches(hits: DataFrame, keys: list[str]) -> DataFrame:
    """D2 in mergeable form: per group of ``keys`` a sketch of its distinct addresses (at most
    about 16 KB, whatever their number).  Partial aggregates hold sketches, not addresses."""
    return hits.groupBy(*keys).agg(F.hll_sketch_agg("email", F.lit(SKETCH_LG)).alias("sketch"))


def unite_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches united by ``keys``: stored days or sources give any range's without their rows."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_emails(sketches: DataFrame) -> DataFrame:
    """``unique_emails_estimate`` of each sketch: off by more than ``SKETCH_ERROR`` of the count in
    three of 370 cases.  ``unique_emails`` is the exact count and stays the contract."""
    return sketches.withColumn("unique_emails_estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


def crawl_summary(outcome: DataFrame, hits: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """A2.  One row: processed pages, failed pages, unique addresses, total hits
    and duration (seconds between first and last fetch; 0 without times).

    ``outcome`` has one row per processed page with ``ok``; ``hits`` one row
    per address per page.  ``enrichment``, if given, has the addresses that
    discovery found: they count as unique addresses and in a column of their own
    (``enrichment_hits``), not as page hits.  All go through one global aggregate
    over their union (no join of one-row results).
    """
    fetched = "fetched_at" if "fetched_at" in outcome.columns else None
    nothing = F.lit(None).cast("string")

    def rows(df, kind, ok, email, time):
        return df.select(F.lit(kind).alias("__kind"), ok.cast("boolean").alias("ok"), email.alias("email"),
                         time.cast("timestamp").alias("__t"))

    u = rows(outcome, "page", F.col("ok"), nothing, F.col(fetched) if fetched else nothing)
    u = u.unionByName(rows(hits, "hit", nothing, F.col("email"), nothing))
    if enrichment is not None:
        u = u.unionByName(rows(enrichment, "found", nothing, F.col("email"), nothing))
    kind = F.col("__kind")
    dur = F.unix_micros(F.max("__t")) - F.unix_micros(F.min("__t"))
    return u.agg(
        F.count_if(kind == "page").alias("processed_pages"),
        F.count_if((kind == "page") & ~F.col("ok")).alias("failed_pages"),
        F.count_distinct("email").alias("unique_email_count"),
        F.count_if(kind == "hit").alias("total_email_hits"),
        *([F.count_if(kind == "found").alias("enrichment_hits")] if enrichment is not None else []),
        F.coalesce(dur / F.lit(1e6), F.lit(0.0)).alias("duration_seconds"),
    )


def running_progress(outcome: DataFrame, hits: DataFrame, order_col: str = "page_id",
                     rows_per_bucket: int | None = None, run_col: str | None = None) -> DataFrame:
    """W1.  After each processed page (in ``order_col`` order): processed,
    failed, unique addresses so far, total hits so far, and the page URL.

    With ``run_col`` (in both inputs) the counters are those of the page's run and
    start anew with each.  A first sighting is found by a group-by on the address
    (min page), so a hot address does not become one window partition; the sums are
    a segmented scan over ranges (``plans.prefix``), so no task holds all pages or a
    whole run.  The sightings are written once, as the text is read once.
    """
    run = [run_col] if run_col else []
    hits = write_through(hits.select(*run, order_col, "email"), "progress_hits")
    first = hits.groupBy(*run, "email").agg(F.min(order_col).alias(order_col))
    # pages, sightings and first sightings meet in one aggregate by page
    rows = (outcome.select(*run, order_col, "url", "ok")
            .unionByName(hits.select(*run, order_col, F.lit(1).alias("__hit")), allowMissingColumns=True)
            .unionByName(first.select(*run, order_col, F.lit(1).alias("__new")), allowMissingColumns=True))
    pages = rows.groupBy(*run, order_col).agg(
        F.max("url").alias("url"), F.bool_and("ok").alias("ok"), F.count("ok").alias("__page"),
        F.count("__hit").alias("__hits"), F.count("__new").alias("__firsts")).where("__page > 0")
    out = running_scan(
        pages, order_col,
        sums={"processed_pages": F.lit(1).cast("long"),
              "failed_pages": F.when(F.col("ok"), 0).otherwise(1).cast("long"),
              "unique_email_count": F.col("__firsts"), "total_email_hits": F.col("__hits")},
        rows_per_bucket=rows_per_bucket, segment=run_col, stored=True)
    return out.select(*run, order_col, F.col("url").alias("current_url"), "processed_pages", "failed_pages",
                      "unique_email_count", "total_email_hits")
