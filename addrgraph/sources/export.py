"""S7: CSV export of the per-address report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the export format.
CSV_HEADER = ["Email", "Hits", "FirstSeen", "LastSeen", "SourceUrl"]
CSV_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


class EmptyReportError(ValueError):
    """Raised when there is no row to export."""


def report_csv_rows(report: DataFrame) -> DataFrame:
    """The export as text columns in export order (address ignoring case)."""
    return (report
            .orderBy(F.lower("email"), "email")
            .select(F.col("email").alias("Email"),
                    F.col("hits").cast("string").alias("Hits"),
                    F.date_format("first_seen", CSV_TIME_FORMAT).alias("FirstSeen"),
                    F.date_format("last_seen", CSV_TIME_FORMAT).alias("LastSeen"),
                    F.col("source_url").alias("SourceUrl")))


def export_report_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the report as CSV: header, ordered by address ignoring case,
    quotes only where a value holds ``"``, ``,``, CR or LF (inner quotes
    doubled), empty values unquoted.  Refuses an empty report.

    By default the range-sorted partitions are written as separate part files
    whose name order is the row order, so no single task holds the report.
    ``single_file=True`` coalesces to one task and is meant for small reports.
    """
    if report.limit(1).count() == 0:
        raise EmptyReportError("No emails available to export.")
    rows = report_csv_rows(report)
    if single_file:
        rows = rows.coalesce(1)
    (rows.write.mode("overwrite")
     .option("header", True)
     .option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
