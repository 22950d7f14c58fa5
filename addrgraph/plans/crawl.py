"""Breadth-first reach over captured pages (G2) and the whole run (G3-G5, L3).

The reference crawls with a FIFO queue.  Here a run is a level-by-level
join loop over a link table extracted once:

* ``edges`` (G1) is built once and written as a table bucketed by ``src_key``:
  no level re-reads ``html``, and no level shuffles the edges.
* All levels stand in one table of visited URLs, bucketed by ``url_key`` and grown
  by one append per level.  A level's frontier, the anti-join with all that was
  seen, and the page status read their tables where they are; the only rows that
  move are a level's candidate links, to their aggregate by URL.
* A page's status is joined after the level's aggregate by URL, when there is
  one row per URL left; a page that every other page links to is one row there.
* FIFO order is ``(depth, path)`` where ``path`` holds the seed's rank and the link's
  rank in each page on the way.  A URL reached first in FIFO order is the one with
  the smallest path, so its parent is one ``min`` aggregate per level (partial
  aggregation).  Every ``PATH_STEPS`` levels the path is replaced by its rank among
  the level's, from a range-partitioned scan, so it stays short at any depth.
* The page budget keeps the FIFO prefix: the level that exceeds it, which is the
  last one, is ranked and cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.functions.urls import url_key
from addrgraph.operators.extract import extract_emails
from addrgraph.operators.links import dedupe_first_wins, link_graph, pages_by_key, seed_hosts
from addrgraph.plans.prefix import global_rank
from addrgraph.session import BucketedLog, bucketed_table, write_through

#: Levels after which paths are replaced by their ranks.
PATH_STEPS = 16
REACH_COLUMNS = ["url_key", "url", "depth", "path", "parent_key", "page_id", "ok", "failure_reason"]


@dataclass(frozen=True)
class CrawlOptions:
    """Data-shaping settings of a run (fetch settings do not apply to tables).

    ``max_pages=None`` means no budget; ``max_depth=None`` means no depth
    limit (the loop then ends when a level is empty).
    """

    max_pages: int | None = 250
    max_depth: int | None = 4
    max_links_per_page: int = 200
    same_host_only: bool = True
    missing_type: str = "accept"
    anchors_only: bool = False


def crawl_edges(pages: DataFrame, seeds: DataFrame, opts: CrawlOptions,
                keyed: DataFrame | None = None) -> DataFrame:
    """G1 for a run: out-links of the captured page chosen for each key,
    limited to the seed hosts when ``same_host_only``.

    Output ``src_key, rank, dst_key, dst_url``.
    """
    keyed = keyed if keyed is not None else pages_by_key(pages, opts.missing_type)
    hosts = seed_hosts(seeds) if opts.same_host_only else None
    edges = link_graph(pages, hosts, opts.max_links_per_page, only_fetchable=True,
                       anchors_only=opts.anchors_only, missing_type=opts.missing_type)
    # Only the capture chosen for the source key contributes links.  (Written as
    # a difference so src_key stays the only join key, which is the bucketing's.)
    chosen = keyed.select(F.col("url_key").alias("src_key"), F.col("page_id").alias("__chosen"))
    edges = edges.join(chosen, "src_key").filter((F.col("page_id") - F.col("__chosen")) == 0)
    return edges.select("src_key", "rank", "dst_key", "dst_url")


def crawl_reach(pages: DataFrame, seeds: DataFrame, opts: CrawlOptions = CrawlOptions(),
                edges: DataFrame | None = None,
                on_level: Callable[[int, int, int | None], None] | None = None) -> DataFrame:
    """G2.  URLs reached from the seeds: ``url_key, url, depth, path,
    parent_key, page_id, ok, failure_reason``.

    Seeds are depth 0 in ``seed_rank`` order (deduped by key, first wins);
    every URL appears once, at its breadth-first depth, with the parent that
    reaches it first in FIFO order.  Only captured HTML pages have out-links.
    Each level is written once.
    ``edges`` (from ``crawl_edges``) lets several runs share one extraction.
    ``on_level(depth, urls, remaining_budget)`` is called after each level with
    counts only (progress reporting; no rows pass through the driver).
    """
    spark = pages.sparkSession
    keyed, keyed_name = bucketed_table(pages_by_key(pages, opts.missing_type), "crawl_pages", "url_key")
    if edges is None:
        edges = crawl_edges(pages, seeds, opts, keyed)
    edges, edges_name = bucketed_table(edges, "crawl_edges", "src_key")
    visited = BucketedLog(spark, "crawl_visited", "url_key")
    try:
        last, cut = _levels(keyed, edges, seeds, opts, visited, on_level)
        reach = spark.read.schema(visited.table().schema).parquet(visited.path)
    finally:  # the levels stand in files of their own
        visited.drop()
        for name in (keyed_name, edges_name):
            spark.sql(f"drop table if exists {name}")
    if cut is not None:
        reach = reach.filter(F.col("depth") < last).unionByName(cut)
    return reach.select(*REACH_COLUMNS)


def _levels(keyed: DataFrame, edges: DataFrame, seeds: DataFrame, opts: CrawlOptions, visited: BucketedLog,
            on_level: Callable[[int, int, int | None], None] | None) -> tuple[int, DataFrame | None]:
    """Append level after level to ``visited``; the last depth, and its rows within the budget
    if the budget cuts it."""
    s = seeds.select(url_key(F.col("url")).alias("url_key"), "url", F.col("seed_rank").cast("long"))
    new = dedupe_first_wins(s, "url_key", "seed_rank").select(
        "url_key", "url", F.lit(0).alias("depth"), F.array(F.col("seed_rank")).alias("path"),
        F.lit(None).cast("string").alias("parent_key"))
    remaining, depth = opts.max_pages, 0
    while True:
        level = new.join(keyed.select("url_key", "page_id", "ok", "failure_reason"), "url_key", "left").select(
            "url_key", "url", "depth", "path", "parent_key", "page_id",
            F.coalesce(F.col("ok"), F.lit(False)).alias("ok"),
            F.when(F.col("page_id").isNull(), F.lit("not captured")).otherwise(F.col("failure_reason")).alias("failure_reason"))
        visited.append(level)
        level = visited.table().filter(F.col("depth") == depth)
        n, cut = level.count(), None
        if remaining is not None:
            if n > remaining:
                cut = write_through(global_rank(level, ["path"], "__rank", stored=True)
                                    .filter(F.col("__rank") < remaining).drop("__rank"), "crawl_cut")
                n = remaining
            remaining -= n
        if on_level and (n or not depth):
            on_level(depth, n, remaining)
        if n == 0 or depth == opts.max_depth or remaining == 0:
            return depth, cut
        if depth % PATH_STEPS == PATH_STEPS - 1:
            level = level.drop("path").join(_short_paths(level), "url_key")
        depth += 1
        frontier = level.filter("ok").select(F.col("url_key").alias("src_key"), "path")
        best = (frontier.join(edges, "src_key").groupBy(F.col("dst_key").alias("url_key"))
                .agg(F.min(F.struct(F.concat("path", F.array(F.col("rank").cast("long"))).alias("path"),
                                    F.col("src_key").alias("parent_key"), F.col("dst_url").alias("url"))).alias("b")))
        # J2: not seen at any earlier level
        new = best.join(visited.table().select("url_key"), "url_key", "left_anti").select(
            "url_key", F.col("b.url").alias("url"), F.lit(depth).alias("depth"), F.col("b.path").alias("path"),
            F.col("b.parent_key").alias("parent_key"))


def _short_paths(level: DataFrame) -> DataFrame:
    """url_key and the rank of the path among the level's, as a path of one number."""
    ranked = global_rank(level.select("url_key", "path"), ["path"], "__rank", stored=True)
    return write_through(ranked.select("url_key", F.array("__rank").alias("path")), "crawl_paths")


def failed_pages(reach: DataFrame) -> DataFrame:
    """G4.  Reached URLs that were not captured or not HTML (processed and failed)."""
    return reach.filter(~F.col("ok")).select("url_key", "url", "depth", "page_id", "failure_reason")


def queue_length_by_level(reach: DataFrame) -> DataFrame:
    """G5.  Per depth: URLs processed at that depth, URLs processed up to it, and
    the queue length once the level is done (the next level's URLs).

    At most ``max_depth + 1`` rows after the group-by, so the ordered window
    runs on a bounded table.
    """
    per = reach.groupBy("depth").agg(F.count(F.lit(1)).alias("urls"))
    w = Window.orderBy("depth")
    return per.select("depth", "urls",
                      F.sum("urls").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("processed_after_level"),
                      F.coalesce(F.lead("urls").over(w), F.lit(0)).alias("queue_after_level"))


@dataclass
class CrawlRun:
    reach: DataFrame
    hits: DataFrame
    report: DataFrame
    summary: DataFrame


def crawl_hits(pages: DataFrame, reach: DataFrame, decode: bool = True, mode: str = "basic") -> DataFrame:
    """P2 on the pages a run processed: ``page_id, source_url, email, depth, path[, seen_at]``.

    Addresses are extracted in the scan, so no page text is shuffled; the few
    sightings then meet the reached pages.  ``seen_at`` is there if the pages
    carry ``fetched_at``.
    """
    time_col = "fetched_at" if "fetched_at" in pages.columns else None
    ok = reach.filter("ok").select("page_id", F.col("url").alias("source_url"), "depth", "path")
    hits = extract_emails(pages, url_col=None, decode=decode, mode=mode, time_col=time_col).drop("source_url")
    return hits.join(ok, "page_id")


def crawl_report(pages: DataFrame, seeds: DataFrame, opts: CrawlOptions = CrawlOptions(),
                 decode: bool = True, mode: str = "basic", edges: DataFrame | None = None,
                 enrichment_emails: DataFrame | None = None) -> CrawlRun:
    """G3.  The whole run: reach -> addresses of processed pages -> per-address
    report (first source in FIFO order) and the run summary (A2).

    ``enrichment_emails`` (column ``email``) join the report as sightings of
    their own source before any page (U2); the summary counts them apart.  With
    ``fetched_at`` in the pages the report has first and last sighting and the
    summary the run's duration.
    """
    from addrgraph.operators.enrich import ENRICHMENT_SOURCE_URL
    from addrgraph.operators.report import crawl_summary

    timed = "fetched_at" in pages.columns
    reach = crawl_reach(pages, seeds, opts, edges)
    hits = write_through(crawl_hits(pages, reach, decode, mode), "crawl_hits")  # for the report and the summary
    seen = hits.select("email", "source_url", "depth", "path", *(["seen_at"] if timed else []))
    extra = None
    if enrichment_emails is not None:
        extra = enrichment_emails.select("email").distinct()
        seen = seen.unionByName(extra.select("email", F.lit(ENRICHMENT_SOURCE_URL).alias("source_url"),
                                             F.lit(-1).alias("depth")), allowMissingColumns=True)
    order = F.struct("depth", "path")
    report = seen.groupBy("email").agg(
        F.count(F.lit(1)).alias("hits"), F.min_by("source_url", order).alias("source_url"),
        F.min(F.when(F.col("depth") >= 0, F.col("depth"))).alias("first_depth"),
        *([F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")] if timed else []))
    outcome = reach.select("ok", "page_id")
    if timed:
        outcome = outcome.join(pages.select("page_id", "fetched_at"), "page_id", "left")
    summary = crawl_summary(outcome.drop("page_id"), hits.select("email"), extra)
    return CrawlRun(reach, hits, report, summary)
