"""Link filters, joins and the per-page link graph (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.functions.urls import blocked_extension, host_of, url_key
from addrgraph.operators.extract import fetchable, first_per_key, link_array


#: Hosts that a page's own filter may hold (a set in the plan); more are joined.
IN_ROW_HOSTS = 4096


def seed_hosts(seeds: DataFrame, url_col: str = "url") -> DataFrame:
    """A5.  Distinct lower-cased hosts of the seeds (partial aggregation)."""
    return seeds.select(host_of(F.col(url_col)).alias("host")).filter(F.col("host").isNotNull()).distinct()


def filter_non_html_ext(links: DataFrame, url_col: str = "dst_url") -> DataFrame:
    """F4.  Drop links whose path extension is a blocked (non-HTML) type."""
    return links.filter(~blocked_extension(F.col(url_col)))


def filter_same_host(links: DataFrame, hosts: DataFrame, url_col: str = "dst_url") -> DataFrame:
    """F3 / J1.  Keep links whose host is one of ``hosts`` (exact, ignoring case).

    A left-semi join; Spark broadcasts the host table if its bytes allow.
    """
    h = hosts.select(F.lower("host").alias("__host")).distinct()
    return (links.withColumn("__host", host_of(F.col(url_col)))
            .join(h, "__host", "left_semi").drop("__host"))


def dedupe_first_wins(df: DataFrame, key_col: str, rank_col: str) -> DataFrame:
    """D3.  One row per key: the row with the smallest rank.

    A group-by with ``min_by`` over a struct of the row (partial aggregation
    collapses hot keys map-side), not a window sort per key.
    """
    others = [c for c in df.columns if c != key_col]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(rank_col)).alias("__best")
    return df.groupBy(key_col).agg(best).select(key_col, *[F.col(f"__best.{c}").alias(c) for c in others])


def cap_links_per_page(links: DataFrame, max_links: int, page_col: str = "page_id",
                       pos_col: str = "pos") -> DataFrame:
    """W3 + L2.  Rank links within their page by position and keep the first n."""
    w = Window.partitionBy(page_col).orderBy(pos_col)
    return links.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= max_links)


def link_graph(pages: DataFrame, hosts: DataFrame | None = None, max_links_per_page: int = 200,
               only_fetchable: bool = True, anchors_only: bool = False,
               missing_type: str = "accept") -> DataFrame:
    """G1.  In-scope out-links per page: extract -> scheme filter -> resolve ->
    extension filter -> per-page distinct -> same-host filter -> cap.

    Output ``page_id, src_key, pos, rank, dst_url, dst_key``.  The cap counts
    every in-scope distinct link of the page (order-independent rule).

    Every step stays inside the page's row, so nothing shuffles and the page's text
    goes no further.  Up to ``IN_ROW_HOSTS`` hosts are part of the row's filter.
    Beyond that bound the link rows are semi-joined with the hosts and a page's links
    are put together again where they are, so at most one row per page is exchanged.
    """
    src = (fetchable(pages, missing_type) if only_fetchable else pages).select("page_id", "url", "html")
    links = F.filter(link_array(anchors_only), lambda s: ~blocked_extension(s["dst_url"]))
    few = None
    if hosts is not None:
        some = hosts.select(F.lower("host").alias("host")).distinct().limit(IN_ROW_HOSTS + 1).collect()
        few = [r["host"] for r in some if r["host"] is not None] if len(some) <= IN_ROW_HOSTS else None
    if hosts is None or few is not None:
        if few is not None:
            links = F.filter(links, lambda s: host_of(s["dst_url"]).isin(few) if few else F.lit(False))
        src = src.select("page_id", url_key(F.col("url")).alias("src_key"), first_per_key(links).alias("__ls"))
    else:
        rows = filter_same_host(src.select("page_id", url_key(F.col("url")).alias("src_key"),
                                           F.explode(first_per_key(links)).alias("__l")), hosts, "__l.dst_url")
        src = rows.groupBy("page_id", "src_key").agg(F.sort_array(F.collect_list("__l")).alias("__ls"))  # by position
    out = src.select("page_id", "src_key", F.posexplode(F.slice("__ls", 1, max_links_per_page)).alias("__i", "__l"))
    return out.select("page_id", "src_key", F.col("__l.pos").alias("pos"), (F.col("__i") + 1).cast("long").alias("rank"),
                      F.col("__l.dst_url").alias("dst_url"), F.col("__l.dst_key").alias("dst_key"))


def unseen_links(links: DataFrame, visited: DataFrame, key_col: str = "dst_key",
                 visited_key: str = "url_key") -> DataFrame:
    """J2.  Candidate links whose key is not yet visited (left anti join)."""
    return links.join(visited.select(F.col(visited_key).alias(key_col)), key_col, "left_anti")


def pages_by_key(pages: DataFrame, missing_type: str = "accept") -> DataFrame:
    """Captured pages keyed by their URL key; the first capture wins per key.

    Output ``url_key, page_id, url, ok, failure_reason`` (no ``html``).
    """
    from addrgraph.operators.extract import split_fetchable

    p = split_fetchable(pages.drop("html") if "html" in pages.columns else pages, missing_type)
    p = p.select(url_key(F.col("url")).alias("url_key"), "page_id", "url", "ok", "failure_reason")
    return dedupe_first_wins(p, "url_key", "page_id")


def match_links_to_pages(frontier: DataFrame, keyed_pages: DataFrame, key_col: str = "url_key") -> DataFrame:
    """J3.  The "fetch": each reached key joined to its captured page (left
    join; no page means a failed fetch)."""
    return frontier.join(keyed_pages, key_col, "left")
