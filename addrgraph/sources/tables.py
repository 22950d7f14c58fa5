"""Reading the input tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(data_dir: str, name: str) -> str:
    return os.path.join(data_dir, f"{name}.parquet")


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(data_dir, name))


def dealt(df: DataFrame, task_rows: int) -> DataFrame:
    """``df`` in partitions of at most about ``task_rows`` rows, however its files are cut.
    Counting reads the files' footers, and only the columns used later are moved."""
    parts = -(-df.count() // task_rows)
    return df.repartition(parts) if parts > 1 else df


def register_tables(spark: SparkSession, data_dir: str, names: list[str] | None = None,
                    task_rows: dict[str, int] | None = None) -> None:
    """Expose the folder's tables as temporary views named after the table; without
    ``names`` those that are there.  Tables of ``task_rows`` are dealt by so many rows."""
    for name in names or TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(data_dir, name))
        if names or path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            df = read_table(spark, data_dir, name)
            (dealt(df, task_rows[name]) if name in (task_rows or {}) else df).createOrReplaceTempView(name)
