"""Breadth-first reach: SURVEY 7.4 check values and invariants."""

from dataclasses import replace

import pytest
from addrgraph.operators.links import link_graph, seed_hosts
from addrgraph.plans.crawl import CrawlOptions, crawl_reach, queue_length_by_level
from addrgraph.plans.fixtures import fixture

from conftest import SF_MID, SF_SMALL

OPEN = CrawlOptions(max_pages=None, max_depth=4)


def _seeds(spark, ks):
    rows = [(i, f"https://h{k % 5}.example.com/c/{k}") for i, k in enumerate(ks)]
    return spark.createDataFrame(rows, "seed_rank int, url string")


@pytest.mark.parametrize("sf_dir,want", [(SF_MID, [2, 3, 7, 13, 18]), (SF_SMALL, [2, 3, 7, 13, 13])])
def test_depth_counts_match_survey(spark, sf_dir, want):
    site = fixture(spark, sf_dir, "site")
    reach = crawl_reach(site, _seeds(spark, [0, 1]), OPEN)
    got = [r[1] for r in reach.groupBy("depth").count().orderBy("depth").collect()]
    assert got == want


def test_invariants(spark):
    site = fixture(spark, SF_MID, "site")
    seeds = _seeds(spark, [0, 1, 2])
    reach = crawl_reach(site, seeds, OPEN)
    rows = reach.collect()
    keys = [r["url_key"] for r in rows]
    assert len(keys) == len(set(keys))
    depth = {r["url_key"]: r["depth"] for r in rows}
    ok = {r["url_key"]: r["ok"] for r in rows}
    edges = link_graph(site, seed_hosts(seeds)).select("src_key", "dst_key").collect()
    refs = {}
    for e in edges:
        if e["src_key"] in depth and ok[e["src_key"]] and depth[e["src_key"]] < 4:
            refs.setdefault(e["dst_key"], []).append(depth[e["src_key"]])
    for r in rows:
        if r["depth"] == 0:
            continue
        assert r["depth"] == 1 + min(refs[r["url_key"]])
        assert r["parent_key"] in depth and depth[r["parent_key"]] == r["depth"] - 1
    again = sorted(tuple(r) for r in crawl_reach(site, seeds, OPEN).drop("path").collect())
    assert again == sorted(tuple(r) for r in reach.drop("path").collect())


def test_budget_is_fifo_prefix(spark):
    site = fixture(spark, SF_MID, "site")
    seeds = _seeds(spark, [0, 1, 2])
    full = crawl_reach(site, seeds, OPEN).orderBy("depth", "path").collect()
    for n in (1, 7, 40):
        cut = crawl_reach(site, seeds, replace(OPEN, max_pages=n)).orderBy("depth", "path").collect()
        assert len(cut) == min(n, len(full))
        assert [r["url_key"] for r in cut] == [r["url_key"] for r in full[:n]]


def test_reach_without_broadcasts_is_the_same(spark):
    site = fixture(spark, SF_SMALL, "site")
    seeds = _seeds(spark, [0, 1])
    a = crawl_reach(site, seeds, OPEN).drop("path").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = crawl_reach(site, seeds, OPEN).drop("path").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_page_linked_by_every_page(spark):
    n = 300
    pages = spark.createDataFrame(
        [(i, f"https://h.com/p{i}", f'<a href="/">home</a><a href="/p{(i + 1) % n}">next</a>') for i in range(n)]
        + [(n, "https://h.com/", '<a href="\n /p7 \t">seven</a>')], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "https://h.com/p0")], "seed_rank int, url string")
    rows = {r["url_key"]: r for r in crawl_reach(pages, seeds, OPEN).collect()}
    assert {k: r["depth"] for k, r in rows.items()} == {
        "https://h.com/p0": 0, "https://h.com/": 1, "https://h.com/p1": 1, "https://h.com/p7": 2, "https://h.com/p2": 2,
        "https://h.com/p8": 3, "https://h.com/p3": 3, "https://h.com/p9": 4, "https://h.com/p4": 4}
    assert rows["https://h.com/"]["parent_key"] == "https://h.com/p0"


def test_no_tables_are_left_in_the_catalog(spark):
    crawl_reach(fixture(spark, SF_SMALL, "site"), _seeds(spark, [0]), OPEN).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("crawl_")]


def test_shared_edges_give_the_same_reach(spark):
    from addrgraph.plans.crawl import crawl_edges

    site, seeds = fixture(spark, SF_SMALL, "site"), _seeds(spark, [0, 1])
    edges = crawl_edges(site, seeds, OPEN)
    a, b = (sorted(map(tuple, crawl_reach(site, seeds, OPEN, edges=e).collect())) for e in (None, edges))
    assert a == b


def test_queue_lengths(spark):
    site = fixture(spark, SF_MID, "site")
    q = queue_length_by_level(crawl_reach(site, _seeds(spark, [0, 1]), OPEN)).orderBy("depth").collect()
    assert [r["urls"] for r in q] == [2, 3, 7, 13, 18]
    assert [r["queue_after_level"] for r in q] == [3, 7, 13, 18, 0]
    assert q[-1]["processed_after_level"] == 43


def test_failed_seed_counts_as_reached(spark):
    site = fixture(spark, SF_SMALL, "site")
    seeds = spark.createDataFrame([(0, "https://h0.example.com/c/999999")], "seed_rank int, url string")
    r = crawl_reach(site, seeds, OPEN).collect()
    assert len(r) == 1 and r[0]["ok"] is False and r[0]["failure_reason"] == "not captured"


def test_unlimited_depth_reaches_closure(spark):
    site = fixture(spark, SF_SMALL, "site")
    seeds = _seeds(spark, [0, 1])
    deep = crawl_reach(site, seeds, replace(OPEN, max_depth=None)).collect()
    four = crawl_reach(site, seeds, OPEN).collect()
    assert len(deep) > len(four)
    assert max(r["depth"] for r in deep) > 4
    # closure: every link of an expanded page in the result leads into the result
    keys = {r["url_key"] for r in deep}
    ok = {r["url_key"] for r in deep if r["ok"]}
    edges = link_graph(site, seed_hosts(seeds)).select("src_key", "dst_key").collect()
    assert all(e["dst_key"] in keys for e in edges if e["src_key"] in ok)


@pytest.mark.parametrize("steps", [1, 2])
def test_short_paths_keep_the_order(spark, monkeypatch, steps):
    """Paths replaced by their ranks after every level, or every other one."""
    from addrgraph.plans import crawl as C

    site, seeds = fixture(spark, SF_MID, "site"), _seeds(spark, [2, 0, 1])
    deep = replace(OPEN, max_depth=7)
    full = crawl_reach(site, seeds, deep).orderBy("depth", "path").drop("path").collect()
    monkeypatch.setattr(C, "PATH_STEPS", steps)
    assert crawl_reach(site, seeds, deep).orderBy("depth", "path").drop("path").collect() == full
    cut = crawl_reach(site, seeds, replace(deep, max_pages=60)).orderBy("depth", "path").drop("path").collect()
    assert cut == full[:60] and len(full) > 60


def test_site_of_one_row_group_is_dealt(spark, tmp_path):
    """Pages are made and read by tasks of bounded rows, however narrow the customers' file is."""
    from pyspark.sql import functions as F

    from addrgraph.plans.fixtures import SITE_SQL

    n = 40_000
    customers = spark.range(n).selectExpr("case when id % 1000 = 7 then null else id div 2 end as c_custkey", "'x' as c_name")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    site = fixture(spark, str(tmp_path), "site")
    sizes = [r["n"] for r in site.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) <= n // 2
    spark.read.parquet(str(tmp_path / "customer.parquet")).createOrReplaceTempView("customer")
    want = spark.sql(SITE_SQL)
    assert site.exceptAll(want).isEmpty() and want.exceptAll(site).isEmpty()
