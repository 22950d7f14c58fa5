"""Named jobs over a data folder: one per operator of the inventory.

Every job reads the folder's tables (or tables Spark derives from them with
``plans.fixtures``) in full and returns a DataFrame.  ``__spark_entry__``
registers them; ``bench.py`` times a subset.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from addrgraph.functions import text as T
from addrgraph.functions.common import strip_ws
from addrgraph.functions import urls as U
from addrgraph.operators import enrich as E
from addrgraph.operators import eventlog as EL
from addrgraph.operators import extract as X
from addrgraph.operators import links as L
from addrgraph.operators import report as R
from addrgraph.plans import crawl as C
from addrgraph.plans.fixtures import DISCOVERY_TARGET_DOMAIN, SUFFIX_LINES, fixture
from addrgraph.sources.discovery import load_discovery
from addrgraph.sources.discovery_files import read_discovery_files
from addrgraph.plans.prefix import global_rank
from addrgraph.session import checkpoint_dir, scratch_path, write_through
from addrgraph.sources.eventlog import parse_event_lines, to_event_json
from addrgraph.sources.eventlog import read_event_log as read_event_log_files
from addrgraph.sources.eventlog import write_event_log as write_event_log_files
from addrgraph.sources.export import export_report_csv as write_report_csv
from addrgraph.sources.export import report_csv_rows
from addrgraph.sources.pages import with_page_defaults
from addrgraph.sources.seeds import load_seeds, load_seeds_lenient
from addrgraph.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered crawl runs (the reference's defaults).
CRAWL = C.CrawlOptions(max_pages=250, max_depth=4, max_links_per_page=200, same_host_only=True)
# A smaller page budget, to exercise the FIFO budget cut (L3) on the test site.
BUDGET_PAGES = 50
# A small per-page link cap, to exercise the cap (L2) on the test pages.
LINK_CAP = 3


# ---- inputs ----------------------------------------------------------------

def _pages(spark, d):
    return with_page_defaults(read_table(spark, d, "pages").select("page_id", "url", "html"))


def _site(spark, d):
    return fixture(spark, d, "site")


def _doc_hits(spark, d):
    docs = read_table(spark, d, "documents")
    # Documents are plain text, not HTML: no character-reference decoding.
    return X.extract_emails(docs, text_col="text", id_col="doc_id", url_col="source", decode=False)


def _strict_seeds(spark, d):
    return load_seeds(fixture(spark, d, "seed_lines"))


def _events(spark, d):
    return parse_event_lines(fixture(spark, d, "event_lines"))


def _discovery(spark, d):
    return load_discovery(fixture(spark, d, "discovery"))


def _site_links(spark, d):
    return X.extract_links(X.fetchable(_site(spark, d)))


# ---- sources -----------------------------------------------------------------

def read_pages(spark, d):
    return _pages(spark, d).select("page_id", "url", "html")


def load_seeds_q(spark, d):
    return _strict_seeds(spark, d)


def load_seeds_lenient_q(spark, d):
    return load_seeds_lenient(fixture(spark, d, "seed_lines"))


def read_event_log(spark, d):
    return _events(spark, d).drop("line")


def write_event_log(spark, d):
    return to_event_json(fixture(spark, d, "hits"), "email", ["email", "source_url"])


def load_discovery_q(spark, d):
    return _discovery(spark, d)


def export_report_csv(spark, d):
    return report_csv_rows(R.email_report(fixture(spark, d, "hits")))


# ---- filters -----------------------------------------------------------------

def split_fetchable(spark, d):
    return X.split_fetchable(_site(spark, d)).select("page_id", "url", "ok", "failure_reason")


def split_fetchable_reject(spark, d):
    # Worker rule: a missing content type is not HTML.
    return X.split_fetchable(_site(spark, d), missing_type="reject").select("page_id", "url", "ok", "failure_reason")


def filter_link_scheme(spark, d):
    return X.extract_links(_pages(spark, d)).select("page_id", "pos", "dst_url")


def filter_same_host(spark, d):
    links = _site_links(spark, d)
    return L.filter_same_host(links, L.seed_hosts(_strict_seeds(spark, d))).select("page_id", "pos", "dst_key")


def filter_non_html_ext(spark, d):
    return L.filter_non_html_ext(_site_links(spark, d)).select("page_id", "pos", "dst_key")


def valid_email(spark, d):
    disc = _discovery(spark, d)
    return disc.select("rec_id", T.valid_email(strip_ws("value"), "basic").alias("basic"),
                       T.valid_email(strip_ws("value"), "strict").alias("strict"))


def filter_hosts_in_domain(spark, d):
    disc = _discovery(spark, d).filter(F.col("kind") == "host")
    hosts = disc.select("rec_id", U.normalize_host(F.col("value")).alias("host")).filter(F.col("host").isNotNull())
    return E.filter_hosts_in_domain(hosts, DISCOVERY_TARGET_DOMAIN)


def filter_sources(spark, d):
    return E.filter_sources(_discovery(spark, d)).select("rec_id", "source")


def drop_incomplete_email_events(spark, d):
    return EL.drop_incomplete_email_events(_events(spark, d))


# ---- projections -------------------------------------------------------------

def decode_html(spark, d):
    return _site(spark, d).select("page_id", T.decode_html(F.col("html")).alias("decoded"))


def extract_emails(spark, d):
    return _doc_hits(spark, d)


def extract_emails_pages(spark, d):
    return X.extract_emails(_pages(spark, d))


def extract_emails_site(spark, d):
    return X.extract_emails(X.fetchable(_site(spark, d)))


def normalize_email(spark, d):
    disc = _discovery(spark, d).filter(F.col("kind") == "email")
    return disc.select("rec_id", T.normalize_email(F.col("value")).alias("email"))


def extract_links(spark, d):
    return X.extract_links(_pages(spark, d)).select("page_id", "pos", "raw", "dst_url", "dst_key")


def extract_anchor_links(spark, d):
    return X.extract_anchor_links(_pages(spark, d)).select("page_id", "pos", "dst_url", "dst_key")


def extract_anchor_links_markup(spark, d):
    """P5 on markup with comments, scripts, quoted ``>`` and attributes that only look like ``href``."""
    return X.extract_anchor_links(fixture(spark, d, "markup")).select("page_id", "pos", "dst_url", "dst_key")


def resolve_links(spark, d):
    return X.extract_links(_site(spark, d)).select("page_id", "pos", "dst_url")


def canonical_url(spark, d):
    return _pages(spark, d).select("page_id", "url", U.url_key(F.col("url")).alias("url_key"))


def normalize_url(spark, d):
    return fixture(spark, d, "seed_lines").select("line_no", U.normalize_url(F.col("line")).alias("url"))


def target_domain(spark, d):
    return E.target_domain(load_seeds_lenient(fixture(spark, d, "seed_lines")))


def normalize_host(spark, d):
    disc = _discovery(spark, d).filter(F.col("kind") == "host")
    return disc.select("rec_id", U.normalize_host(F.col("value")).alias("host"))


def hosts_to_seeds(spark, d):
    hosts = (E.enrichment_sets(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)
             .filter(F.col("kind") == "host").select(F.col("value").alias("host")))
    return E.hosts_to_seeds(hosts)


def failure_log(spark, d):
    return X.failure_log(_site(spark, d))


def host_ext(spark, d):
    return _pages(spark, d).select("page_id", U.host_of(F.col("url")).alias("host"),
                                   U.ext_of(F.col("url")).alias("ext"))


# ---- joins -------------------------------------------------------------------

def unseen_links(spark, d):
    seeds = _strict_seeds(spark, d).select(U.url_key(F.col("url")).alias("url_key"))
    return L.unseen_links(_site_links(spark, d), seeds).select("page_id", "pos", "dst_key")


def match_links_to_pages(spark, d):
    site = _site(spark, d)
    links = L.link_graph(site, L.seed_hosts(_strict_seeds(spark, d)))
    keyed = L.pages_by_key(site)
    return (L.match_links_to_pages(links.select("page_id", "rank", F.col("dst_key").alias("url_key")), keyed
                                   .withColumnRenamed("page_id", "dst_page_id"))
            .select("page_id", "rank", "url_key", "dst_page_id", "ok"))


# ---- distinct / dedupe -------------------------------------------------------

def unique_emails(spark, d):
    return R.unique_emails(_doc_hits(spark, d))


def unique_emails_sketch(spark, d):
    """D2 by stored sketches per source host and day, united over each day and all before it,
    beside the exact counts; the estimate is reported as within its stated error or not."""
    hits = fixture(spark, d, "hits").select("email", U.host_of(F.col("source_url")).alias("host"), F.to_date("seen_at").alias("day"))
    stored = write_through(R.email_sketches(hits, ["host", "day"]), "sketches")
    days = stored.select("day").distinct()
    upto = stored.withColumnRenamed("day", "of").join(days, F.col("of") <= F.col("day"))
    estimate = R.estimated_emails(R.unite_sketches(upto, ["day"]))
    first = hits.groupBy("email").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("new"))
    # one row per day
    upto_day = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    exact = days.join(first, "day", "left").select("day", F.sum(F.coalesce("new", F.lit(0))).over(upto_day).alias("unique_emails"))
    off = F.abs(F.col("unique_emails_estimate") - F.col("unique_emails"))
    return exact.join(estimate, "day").select(
        "day", "unique_emails", (off <= F.greatest(F.lit(1.0), F.lit(R.SKETCH_ERROR) * F.col("unique_emails"))).alias("within_error"))


def dedupe_urls_first_wins(spark, d):
    return L.pages_by_key(_pages(spark, d)).select("url_key", "page_id", "url")


# ---- aggregates --------------------------------------------------------------

def email_report(spark, d):
    return R.email_report(fixture(spark, d, "hits"))


def document_email_report(spark, d):
    return R.document_email_report(_doc_hits(spark, d))


def crawl_summary(spark, d):
    site = X.split_fetchable(_site(spark, d))
    hits = X.extract_emails(site.filter("ok"))
    return R.crawl_summary(site, hits)


def enrichment_counts(spark, d):
    return E.enrichment_counts(spark, _discovery(spark, d), DISCOVERY_TARGET_DOMAIN)


def enrichment_sets(spark, d):
    return E.enrichment_sets(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)


def seed_hosts(spark, d):
    return L.seed_hosts(_strict_seeds(spark, d))


def event_log_summary(spark, d):
    return EL.event_log_summary(_events(spark, d))


# ---- windows -----------------------------------------------------------------

def running_progress(spark, d):
    site = X.split_fetchable(_site(spark, d))
    hits = X.extract_emails(site.filter("ok"))
    return R.running_progress(site, hits)


def carry_forward(spark, d):
    return EL.carry_forward(_events(spark, d))


def _run_events(spark, d):
    return parse_event_lines(fixture(spark, d, "run_lines"), keep=["run_id"])


def carry_forward_runs(spark, d):
    """W2 over a log of interleaved runs."""
    return EL.carry_forward(_run_events(spark, d), run_col="run_id")


def event_log_summary_runs(spark, d):
    """A6 for each run of a log."""
    return EL.event_log_summary(_run_events(spark, d), run_col="run_id")


def running_progress_runs(spark, d):
    """W1 where the pages belong to several runs, one of them a third of all."""
    run = F.when(F.col("page_id") % 3 == 0, F.lit(0)).otherwise(F.col("page_id") % 7).cast("long")
    site = X.split_fetchable(_site(spark, d)).withColumn("run_id", run)
    hits = X.extract_emails(site.filter("ok")).withColumn("run_id", run)
    return R.running_progress(site, hits, run_col="run_id")


def cap_links_per_page(spark, d):
    links = X.extract_links(_pages(spark, d))
    return L.cap_links_per_page(links, LINK_CAP).select("page_id", "pos", "rank", "dst_key")


# ---- sorts / limits ----------------------------------------------------------

def order_report(spark, d):
    return R.order_report(R.email_report(fixture(spark, d, "hits")))


def cap_enrichment_seeds(spark, d):
    return E.cap_enrichment_seeds(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)


def sorted_enrichment_emails(spark, d):
    return E.sorted_enrichment_emails(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)


def log_messages(spark, d):
    return EL.log_messages(_events(spark, d))


def keep_last_lines(spark, d):
    return EL.keep_last_lines(EL.log_messages(_events(spark, d)))


def error_tail(spark, d):
    msgs = _events(spark, d).filter(F.col("kind") == "unparsed").select("line_no", F.col("line").alias("message"))
    return EL.error_tail(msgs)


# ---- set operations ----------------------------------------------------------

def add_enrichment_seeds(spark, d):
    seeds = load_seeds_lenient(fixture(spark, d, "seed_lines"))
    hosts = E.cap_enrichment_seeds(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)
    return E.add_enrichment_seeds(seeds, hosts)


def add_enrichment_hits(spark, d):
    emails = E.sorted_enrichment_emails(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)
    return E.add_enrichment_hits(fixture(spark, d, "hits"), emails)


def enriched_email_report(spark, d):
    return R.email_report(add_enrichment_hits(spark, d))


# ---- graph -------------------------------------------------------------------

def link_graph(spark, d):
    return L.link_graph(_site(spark, d), L.seed_hosts(_strict_seeds(spark, d)))


def _reach(spark, d, opts=CRAWL):
    return C.crawl_reach(_site(spark, d), _strict_seeds(spark, d), opts)


def crawl_reach(spark, d):
    return _reach(spark, d).select("url_key", "depth", "parent_key", "page_id", "ok")


def crawl_reach_worker(spark, d):
    from dataclasses import replace

    # Worker rules: missing content type rejected, link elements only.
    opts = replace(CRAWL, missing_type="reject", anchors_only=True)
    return _reach(spark, d, opts).select("url_key", "depth", "parent_key", "page_id", "ok")


def page_budget(spark, d):
    from dataclasses import replace

    return _reach(spark, d, replace(CRAWL, max_pages=BUDGET_PAGES)).select("url_key", "depth", "parent_key")


def failed_pages(spark, d):
    return C.failed_pages(_reach(spark, d))


def queue_length_by_level(spark, d):
    return C.queue_length_by_level(_reach(spark, d))


def crawl_report(spark, d):
    return C.crawl_report(_site(spark, d), _strict_seeds(spark, d), CRAWL).report


def crawl_report_summary(spark, d):
    return C.crawl_report(_site(spark, d), _strict_seeds(spark, d), CRAWL).summary


def crawl_reach_unbudgeted(spark, d):
    from dataclasses import replace

    return _reach(spark, d, replace(CRAWL, max_pages=None)).select("url_key", "depth", "parent_key", "page_id", "ok")


def crawl_report_unbudgeted(spark, d):
    from dataclasses import replace

    return C.crawl_report(_site(spark, d), _strict_seeds(spark, d), replace(CRAWL, max_pages=None)).report


def crawl_report_budget(spark, d):
    """G3 where the page budget binds: only pages within it give addresses."""
    from dataclasses import replace

    return C.crawl_report(_site(spark, d), _strict_seeds(spark, d), replace(CRAWL, max_pages=BUDGET_PAGES)).report


def _enriched_run(spark, d):
    """Seeds joined by discovered hosts, timed pages, discovered addresses in the report."""
    site = _site(spark, d).withColumn("fetched_at", F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id)"))
    emails = E.sorted_enrichment_emails(_discovery(spark, d), DISCOVERY_TARGET_DOMAIN)
    return C.crawl_report(site, add_enrichment_seeds(spark, d), CRAWL, enrichment_emails=emails)


def crawl_report_enriched(spark, d):
    return _enriched_run(spark, d).report


def crawl_summary_enriched(spark, d):
    return _enriched_run(spark, d).summary


def order_report_ranked(spark, d):
    """The order itself as a column: rank by a range-partitioned scan over the report."""
    report = R.email_report(fixture(spark, d, "hits")).withColumn("folded", F.lower("email"))
    return global_rank(report, ["folded", "email"], "row_no").select("email", "hits", "row_no")


def write_read_event_log(spark, d):
    """S5 and back: sightings written as NDJSON text in the shared folder, read as S4."""
    hits = fixture(spark, d, "hits").select("email", "source_url")
    path = os.path.join(checkpoint_dir(spark), "tables", f"event_log_{uuid.uuid4().hex[:12]}")
    write_event_log_files(hits, path, "email", ["email", "source_url"])
    return read_event_log_files(spark, path).select("kind", "email", "source_url")


def write_read_report_csv(spark, d):
    """S7 and back: the report written as CSV in the shared folder, read by Spark's CSV reader."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"report_{uuid.uuid4().hex[:12]}")
    write_report_csv(R.email_report(fixture(spark, d, "hits")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


def target_domain_with_suffixes(spark, d):
    """P9 with a suffix table: hosts of the site cut to one label above the longest listed suffix."""
    suffixes = spark.sql("select * from values ('com'), ('example.com') as t(suffix)")
    hosts = _site(spark, d).select(U.host_of(F.col("url")).alias("host")).distinct()
    return E.registrable_domains(hosts, suffixes)


#: Formats in which the discovery records are laid out as files of their sources.
SOURCE_FORMATS = {"crtsh": "json", "rapiddns": "csv", "waybackarchive": "parquet", "commoncrawl": "json", "thc": "csv",
                  "duckduckgo": "parquet", "nosuch": "json"}


def source_folder(spark, d) -> str:
    """The discovery records as ``<source>.<format>`` folders in the shared folder."""
    top = scratch_path(spark, "sources")
    records = fixture(spark, d, "discovery")
    for source, fmt in SOURCE_FORMATS.items():
        w = records.filter(F.col("source") == source).drop("source").write
        if fmt == "csv":
            w = w.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        w.format(fmt).save(f"{top}/{source}.{fmt}")
    return top


def load_discovery_files(spark, d):
    """S6 from one file or folder per source, each by its format's reader."""
    records, _ = read_discovery_files(spark, source_folder(spark, d))
    return records


def registrable_domains(spark, d):
    """P9 with wildcard and exception rules over all hosts."""
    rules = E.load_suffix_rules(spark.createDataFrame([(x,) for x in SUFFIX_LINES], "line string"))
    return E.registrable_domains(fixture(spark, d, "hosts"), rules)


def filter_sources_given(spark, d):
    return E.filter_sources(_discovery(spark, d), [" CRTSH ", "thc", "bogus", "thc"]).select("rec_id", "source")


QUERIES: dict[str, Query] = {
    "filter_sources_given": filter_sources_given,
    "load_discovery_files": load_discovery_files,
    "registrable_domains": registrable_domains,
    "crawl_reach_unbudgeted": crawl_reach_unbudgeted,
    "crawl_report_unbudgeted": crawl_report_unbudgeted,
    "crawl_report_budget": crawl_report_budget,
    "crawl_report_enriched": crawl_report_enriched,
    "crawl_summary_enriched": crawl_summary_enriched,
    "order_report_ranked": order_report_ranked,
    "write_read_event_log": write_read_event_log,
    "write_read_report_csv": write_read_report_csv,
    "target_domain_with_suffixes": target_domain_with_suffixes,
    # sources and sinks
    "read_pages": read_pages,
    "load_seeds": load_seeds_q,
    "load_seeds_lenient": load_seeds_lenient_q,
    "read_event_log": read_event_log,
    "write_event_log": write_event_log,
    "load_discovery": load_discovery_q,
    "export_report_csv": export_report_csv,
    # filters
    "split_fetchable": split_fetchable,
    "split_fetchable_reject": split_fetchable_reject,
    "filter_link_scheme": filter_link_scheme,
    "filter_same_host": filter_same_host,
    "filter_non_html_ext": filter_non_html_ext,
    "valid_email": valid_email,
    "filter_hosts_in_domain": filter_hosts_in_domain,
    "filter_sources": filter_sources,
    "drop_incomplete_email_events": drop_incomplete_email_events,
    # projections / generators
    "decode_html": decode_html,
    "extract_emails": extract_emails,
    "extract_emails_pages": extract_emails_pages,
    "extract_emails_site": extract_emails_site,
    "normalize_email": normalize_email,
    "extract_links": extract_links,
    "extract_anchor_links": extract_anchor_links,
    "extract_anchor_links_markup": extract_anchor_links_markup,
    "resolve_links": resolve_links,
    "canonical_url": canonical_url,
    "normalize_url": normalize_url,
    "target_domain": target_domain,
    "normalize_host": normalize_host,
    "hosts_to_seeds": hosts_to_seeds,
    "failure_log": failure_log,
    "host_ext": host_ext,
    # joins
    "unseen_links": unseen_links,
    "match_links_to_pages": match_links_to_pages,
    # distinct
    "unique_emails": unique_emails,
    "unique_emails_sketch": unique_emails_sketch,
    "dedupe_urls_first_wins": dedupe_urls_first_wins,
    # aggregates
    "email_report": email_report,
    "document_email_report": document_email_report,
    "crawl_summary": crawl_summary,
    "enrichment_counts": enrichment_counts,
    "enrichment_sets": enrichment_sets,
    "seed_hosts": seed_hosts,
    "event_log_summary": event_log_summary,
    # windows
    "running_progress": running_progress,
    "carry_forward": carry_forward,
    "carry_forward_runs": carry_forward_runs,
    "event_log_summary_runs": event_log_summary_runs,
    "running_progress_runs": running_progress_runs,
    "cap_links_per_page": cap_links_per_page,
    # sorts, limits
    "order_report": order_report,
    "cap_enrichment_seeds": cap_enrichment_seeds,
    "sorted_enrichment_emails": sorted_enrichment_emails,
    "log_messages": log_messages,
    "keep_last_lines": keep_last_lines,
    "error_tail": error_tail,
    # set operations
    "add_enrichment_seeds": add_enrichment_seeds,
    "add_enrichment_hits": add_enrichment_hits,
    "enriched_email_report": enriched_email_report,
    # graph
    "link_graph": link_graph,
    "crawl_reach": crawl_reach,
    "crawl_reach_worker": crawl_reach_worker,
    "page_budget": page_budget,
    "failed_pages": failed_pages,
    "queue_length_by_level": queue_length_by_level,
    "crawl_report": crawl_report,
    "crawl_report_summary": crawl_report_summary,
}
