"""Plan shapes that matter at scale, checked with explain output."""

import pytest

from addrgraph.operators import extract as X
from addrgraph.operators import links as L
from addrgraph.plans import crawl as C
from addrgraph import session as S
from addrgraph.plans import queries as Q
from addrgraph.plans.fixtures import fixture
from addrgraph.sources.seeds import load_seeds

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_aggregates_partially(spark):
    p = _plan(Q.document_email_report(spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p
    assert "partial_count" in p  # map-side combine before the shuffle by address
    assert "hashpartitioning(email" in p


def test_row_local_jobs_do_not_shuffle_text(spark):
    site = fixture(spark, SF_SMALL, "site")
    pages = Q._pages(spark, SF_SMALL)
    assert "Exchange" not in _plan(L.link_graph(pages))
    assert "Exchange" not in _plan(X.extract_links(pages)) and "Exchange" not in _plan(X.extract_anchor_links(pages))
    hosts = L.seed_hosts(load_seeds(fixture(spark, SF_SMALL, "seed_lines")))
    for p in (_plan(L.link_graph(site, hosts)), _plan(Q.document_email_report(spark, SF_SMALL)), _plan(Q.read_event_log(spark, SF_SMALL))):
        assert "RoundRobinPartitioning" not in p


def test_running_progress_reads_the_text_once(spark):
    p = _plan(Q.running_progress(spark, SF_SMALL))
    assert "regexp_extract_all" not in p and "SinglePartition" in p  # of at most two rows per range


def test_link_rows_are_not_exchanged(spark, monkeypatch):
    site = S.write_through(fixture(spark, SF_SMALL, "site"), "site")
    hosts = L.seed_hosts(load_seeds(fixture(spark, SF_SMALL, "seed_lines")))
    assert "Exchange" not in _plan(L.link_graph(site, hosts))
    monkeypatch.setattr(L, "IN_ROW_HOSTS", 0)  # more hosts than a row's filter may hold
    p = _plan(L.link_graph(site, hosts))
    # a page's links are one row before they move
    assert p.count("Exchange hashpartitioning(page_id") == 1 and "partial_collect_list" in p and "Window" not in p


@pytest.mark.parametrize("threshold", [None, "-1"])
def test_crawl_level_moves_candidates_only(spark, monkeypatch, threshold):
    """Edges, page status and all visited URLs are read where they are, with Spark's own choice of joins and with none broadcast."""
    plans, orig = [], S.BucketedLog.append
    monkeypatch.setattr(S.BucketedLog, "append", lambda self, df: (plans.append(_plan(df)), orig(self, df))[1])
    site = fixture(spark, SF_SMALL, "site")
    seeds = load_seeds(fixture(spark, SF_SMALL, "seed_lines"))
    if threshold:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        C.crawl_reach(site, seeds, C.CrawlOptions(max_pages=None)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 5  # one append per level
    for plan in plans[1:]:
        assert "partial_min" in plan and plan.count("Exchange hashpartitioning") == 1  # the aggregate by destination
        assert plan.count("Exchange hashpartitioning(dst_key") == 1
        for table in ("crawl_edges", "crawl_pages", "crawl_visited"):
            assert table in plan
    if threshold:
        assert plans[-1].count("Bucketed: true") == 4  # frontier, edges, visited, pages


def test_crawl_reports_levels(spark):
    site = fixture(spark, SF_SMALL, "site")
    seeds = load_seeds(fixture(spark, SF_SMALL, "seed_lines"))
    seen = []
    reach = C.crawl_reach(site, seeds, C.CrawlOptions(max_pages=30), on_level=lambda d, n, r: seen.append((d, n, r)))
    assert sum(n for _, n, _ in seen) == reach.count() <= 30
    assert seen[-1][2] >= 0 and [d for d, _, _ in seen] == list(range(len(seen)))
