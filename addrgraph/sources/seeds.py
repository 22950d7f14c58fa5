"""S2/S3: seed-URL lists, strict and lenient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrgraph.functions.common import strip_ws
from addrgraph.functions.urls import normalize_url, strict_seed_url


class SeedFormatError(ValueError):
    """Raised by ``load_seeds`` when a line is not an absolute http(s) URL."""


def _absolute_uri_key(u):
    """Case-insensitive identity of a parsed URL as written (fragment kept):
    lower-cased, default port dropped, empty path shown as ``/``."""
    a = F.lower(u)
    a = F.regexp_replace(a, r"^(http://[^/?#]+):80([/?#]|$)", "$1$2")
    a = F.regexp_replace(a, r"^(https://[^/?#]+):443([/?#]|$)", "$1$2")
    return F.regexp_replace(a, r"^(https?://[^/?#]+)([?#]|$)", "$1/$2")


def load_seeds(lines: DataFrame, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """S2.  Strict seed list: ``seed_rank, url``.

    Blank lines are skipped; a line without an http(s) scheme (case-insensitive
    test) gets ``https://``.  If any line is not an absolute http(s) URL the
    whole input is refused, naming the first three bad lines (`` ...`` when
    there are more).  Duplicates ignoring case collapse to the first line.
    ``seed_rank`` is the line order of the first occurrence.
    """
    v = lines.select(F.col(order_col).alias("seed_rank"), strip_ws(F.col(line_col)).alias("value"))
    v = v.filter(F.length("value") > 0).withColumn("url", strict_seed_url("value"))
    bad = v.filter(F.col("url").isNull()).orderBy("seed_rank").limit(4).collect()
    if bad:
        sample = ", ".join(r["value"] for r in bad[:3])
        raise SeedFormatError(f"Invalid URL format: {sample}{' ...' if len(bad) > 3 else ''}")
    return (v.groupBy(_absolute_uri_key(F.col("url")).alias("k"))
            .agg(F.min_by("url", "seed_rank").alias("url"), F.min("seed_rank").alias("seed_rank"))
            .select("seed_rank", "url"))


def load_seeds_lenient(lines: DataFrame, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """S3.  Lenient seed list: invalid lines dropped silently, fragment removed,
    exact-text dedupe keeping the first line."""
    v = lines.select(F.col(order_col).alias("seed_rank"), normalize_url(F.col(line_col)).alias("url"))
    return (v.filter(F.col("url").isNotNull())
            .groupBy("url").agg(F.min("seed_rank").alias("seed_rank"))
            .select("seed_rank", "url"))
