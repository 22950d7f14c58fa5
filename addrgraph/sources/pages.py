"""S1: captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ["page_id", "url", "html"]
OPTIONAL_COLUMNS = {"status": "int", "content_type": "string", "fetched_at": "timestamp"}


def with_page_defaults(df: DataFrame) -> DataFrame:
    """Add the optional capture columns as typed nulls when a table lacks them."""
    for name, typ in OPTIONAL_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    return df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per captured page: ``page_id, url, html[, status, content_type, fetched_at]``.

    Only these columns are selected, so Parquet reads nothing else; callers
    that never touch ``html`` (link keys, failure logs) do not read it either.
    """
    df = spark.read.parquet(path)
    return with_page_defaults(df).select(*PAGE_COLUMNS, *OPTIONAL_COLUMNS)
