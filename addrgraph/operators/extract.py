"""Per-page generators: page -> addresses, page -> links, page -> failure text.

All of them are projections (``explode`` of an in-row array): no shuffle,
the work scales with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrgraph.functions.common import let, strip_ws
from addrgraph.functions.markup import link_values, unquoted
from addrgraph.functions.text import decode_html, page_emails
from addrgraph.functions.urls import (blocked_extension, is_http_url, resolve_url, skipped_link,
                                      url_key)
from addrgraph.sources.pages import with_page_defaults

# ---------------------------------------------------------------------------
# Fixed value: the link-attribute pattern.  One capture group holding the value
# with its quotes, if any (stripped afterwards).
HREF_PATTERN = r"""(?i)href\s*=\s*("[^">]+"|'[^'>]+'|[^\s>]+)"""
# ---------------------------------------------------------------------------


def _strip_quotes(v: Column) -> Column:
    return F.when(v.rlike(r"""^"[^">]+"$""") | v.rlike(r"""^'[^'>]+'$"""),
                  F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def _media_type(ct: Column) -> Column:
    return strip_ws(F.substring_index(ct, ";", 1))


def split_fetchable(pages: DataFrame, missing_type: str = "accept") -> DataFrame:
    """F1.  Add ``ok`` and ``failure_reason``.

    ok = status 2xx (a missing status counts as 2xx) and the media type holds
    ``html`` ignoring case.  A missing/blank type is accepted (``'accept'``,
    native rule) or rejected (``'reject'``, worker rule).
    """
    if missing_type not in ("accept", "reject"):
        raise ValueError("missing_type must be 'accept' or 'reject'")
    p = with_page_defaults(pages)
    status, mt = F.col("status"), _media_type(F.col("content_type"))
    status_ok = status.isNull() | status.between(200, 299)
    blank = mt.isNull() | (F.length(mt) == 0)
    type_ok = F.when(blank, F.lit(missing_type == "accept")).otherwise(F.lower(mt).contains("html"))
    reason = (F.when(~status_ok, F.concat(F.lit("HTTP "), status.cast("string")))
              .when(~type_ok & blank, F.lit("Content type 'unknown' is not HTML"))
              .when(~type_ok, F.concat(F.lit("Content type '"), mt, F.lit("' is not HTML"))))
    return p.withColumn("ok", status_ok & type_ok).withColumn("failure_reason", reason)


def fetchable(pages: DataFrame, missing_type: str = "accept") -> DataFrame:
    """Pages whose body is processed.  The predicates touch only ``status`` and
    ``content_type``; Parquet pushes them down before ``html`` is decoded."""
    return split_fetchable(pages, missing_type).filter("ok").drop("ok", "failure_reason")


def failure_log(pages: DataFrame, missing_type: str = "accept") -> DataFrame:
    """P13.  One text row per skipped page: ``page_id, url, reason, message``."""
    f = split_fetchable(pages, missing_type).filter(~F.col("ok"))
    return f.select("page_id", "url", F.col("failure_reason").alias("reason"),
                    F.concat(F.lit("Skipped "), F.col("url"), F.lit(": "), F.col("failure_reason")).alias("message"))


def extract_emails(pages: DataFrame, text_col: str = "html", id_col: str = "page_id",
                   url_col: str | None = "url", decode: bool = True, mode: str = "basic",
                   time_col: str | None = None) -> DataFrame:
    """P2 (+D1).  One row per distinct address per page.

    Output ``page_id, source_url, email[, seen_at]``.  Matching, checking,
    lower-casing and the per-page distinct all happen inside the row.
    """
    cols = [F.col(id_col).alias("page_id"),
            (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("source_url")]
    if time_col:
        cols.append(F.col(time_col).alias("seen_at"))
    src = pages.select(*cols, F.col(text_col).alias("__text"))
    out = [c for c in src.columns if c != "__text"]
    arr = page_emails(F.coalesce(F.col("__text"), F.lit("")), decode=decode, mode=mode)
    return src.select(*out, F.explode(arr).alias("email"))


def link_array(anchors_only: bool = False) -> Column:
    """Per-page array of ``struct<pos, raw, dst_url, dst_key>`` in document order,
    built from the row's ``url`` and ``html`` columns (P4/P5 + F2 + P6 + P7).

    The work is done inside the row, one small ``transform``/``filter`` stage
    per rule; each stage's values are stored in the array, so later rules
    read them instead of recomputing.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    if anchors_only:
        hrefs, unquote = link_values(html), unquoted
    else:
        hrefs, unquote = F.when(F.lower(html).contains("href"), F.regexp_extract_all(html, F.lit(HREF_PATTERN), 1)).otherwise(
            F.array().cast("array<string>")), _strip_quotes
    src = F.col("url")
    a = F.transform(hrefs, lambda h, i: F.struct(i.alias("pos"), h.alias("raw"), unquote(h).alias("v")))
    a = F.transform(a, lambda s: F.struct(s["pos"].alias("pos"), s["raw"].alias("raw"), strip_ws(
        F.when(s["v"].contains("&"), decode_html(s["v"])).otherwise(s["v"])).alias("v")))
    a = F.filter(a, lambda s: ~skipped_link(s["v"]))
    a = F.transform(a, lambda s: F.struct(s["pos"].alias("pos"), s["raw"].alias("raw"),
                                          resolve_url(src, s["v"]).alias("dst")))
    a = F.filter(a, lambda s: s["dst"].isNotNull() & is_http_url(s["dst"]))
    if anchors_only:
        a = F.filter(a, lambda s: ~blocked_extension(s["dst"]))
    return F.transform(a, lambda s: F.struct(s["pos"].alias("pos"), s["raw"].alias("raw"),
                                             s["dst"].alias("dst_url"), url_key(s["dst"]).alias("dst_key")))


def extract_links(pages: DataFrame, anchors_only: bool = False) -> DataFrame:
    """P4/P5 + F2 + P6.  Links of each page in document order.

    Output ``page_id, src_url, pos, raw, dst_url, dst_key``: the raw attribute
    value, the resolved absolute http(s) URL without fragment, and its key.
    ``anchors_only`` takes ``href`` of ``a``/``area`` elements only (``functions.markup``).  The rows
    are exploded only at the end (see ``link_array``).  No shuffle.
    """
    return pages.select("page_id", F.col("url").alias("src_url"), F.inline(link_array(anchors_only)))


def first_per_key(links: Column) -> Column:
    """An array of links in document order, each key's first only.

    Sorts by (key, position), keeps the first of each key and sorts back:
    O(n log n) in the page's link count.
    """
    by_key = F.array_sort(F.transform(links, lambda s: F.struct(
        s["dst_key"].alias("dst_key"), s["pos"].alias("pos"), s["raw"].alias("raw"), s["dst_url"].alias("dst_url"))))
    firsts = let(by_key, lambda arr: F.filter(arr, lambda s, i: (i == 0) | (F.element_at(arr, i)["dst_key"] != s["dst_key"])))
    return F.array_sort(F.transform(firsts, lambda s: F.struct(
        s["pos"].alias("pos"), s["raw"].alias("raw"), s["dst_url"].alias("dst_url"), s["dst_key"].alias("dst_key"))))


def extract_anchor_links(pages: DataFrame) -> DataFrame:
    """P5 (+D4).  ``href`` of link elements, unique per page (first position
    kept), blocked extensions denied; all inside the page's row, no shuffle."""
    return pages.select("page_id", F.col("url").alias("src_url"), F.inline(first_per_key(link_array(True))))
