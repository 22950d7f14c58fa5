"""S6: discovery (enrichment) records, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from addrgraph.functions.common import strip_ws

DISCOVERY_SCHEMA = "rec_id long, source string, kind string, value string"


def load_discovery(df: DataFrame) -> DataFrame:
    """Normalise a ``(source, kind, value)`` table: source lower-cased and trimmed,
    kind lower-cased.  Works the same on a streaming DataFrame."""
    cols = [F.col("rec_id")] if "rec_id" in df.columns else [F.monotonically_increasing_id().alias("rec_id")]
    return df.select(*cols,
                     F.lower(strip_ws("source")).alias("source"),
                     F.lower(strip_ws("kind")).alias("kind"),
                     F.col("value").cast("string").alias("value"))


def read_discovery(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return load_discovery(spark.read.format(fmt).load(path))
