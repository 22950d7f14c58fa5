"""G1: the link graph equals its steps taken one after the other on link rows."""

from pyspark.sql import functions as F

import pytest

from addrgraph.operators import links as L
from addrgraph.operators.extract import extract_links, fetchable
from addrgraph.plans.fixtures import fixture
from addrgraph.sources.seeds import load_seeds

from conftest import SF_SMALL


@pytest.mark.parametrize("in_row", [0, 4096])
def test_graph_equals_its_steps(spark, monkeypatch, in_row):
    monkeypatch.setattr(L, "IN_ROW_HOSTS", in_row)  # the hosts joined, and in the row
    site = fixture(spark, SF_SMALL, "site")
    hosts = L.seed_hosts(load_seeds(fixture(spark, SF_SMALL, "seed_lines")))
    for cap in (1, 2, 200):
        a = sorted(map(tuple, L.link_graph(site, hosts, cap).drop("src_key").collect()))
        links = L.filter_same_host(L.filter_non_html_ext(extract_links(fetchable(site))), hosts)
        first = links.groupBy("page_id", "dst_key").agg(F.min("pos").alias("pos"), F.min_by("dst_url", "pos").alias("dst_url"))
        b = L.cap_links_per_page(first, cap).select("page_id", "pos", "rank", "dst_url", "dst_key")
        assert a == sorted(map(tuple, b.collect())) and len(a) > 0


def test_in_row_distinct_keeps_first_position(spark):
    html = ('<a href="/b">1</a><a href="/a">2</a><a href="/B">3</a><a href="/c.css">4</a>'
            '<a href="https://other.org/x">5</a><a href="/a#f">6</a><a href="/d">7</a>')
    pages = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
    hosts = spark.createDataFrame([("h.com",)], "host string")
    rows = [tuple(r) for r in L.link_graph(pages, hosts, 2).select("pos", "rank", "dst_key").collect()]
    assert rows == [(0, 1, "https://h.com/b"), (1, 2, "https://h.com/a")]
    rows = [tuple(r) for r in L.link_graph(pages, None, 10).select("pos", "rank", "dst_key").collect()]
    assert rows == [(0, 1, "https://h.com/b"), (1, 2, "https://h.com/a"), (4, 3, "https://other.org/x"),
                    (6, 4, "https://h.com/d")]


@pytest.mark.parametrize("in_row", [0, 4096])
def test_graph_without_a_host_is_empty(spark, monkeypatch, in_row):
    monkeypatch.setattr(L, "IN_ROW_HOSTS", in_row)
    site = fixture(spark, SF_SMALL, "site")
    assert L.link_graph(site, spark.createDataFrame([], "host string")).count() == 0
    assert L.link_graph(site, spark.createDataFrame([(None,)], "host string")).count() == 0
