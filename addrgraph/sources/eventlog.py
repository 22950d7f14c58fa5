"""S4/S5: the typed NDJSON event log (email / progress / log / summary)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrgraph.functions.common import strip_ws

# Fields of the protocol, by value kind.
STRING_FIELDS = ["email", "source_url", "current_url", "message", "reason"]
INT_FIELDS = ["processed_pages", "failed_pages", "unique_email_count", "total_email_hits", "queue_length"]
DOUBLE_FIELDS = ["duration_seconds"]

EVENT_COLUMNS = ["line_no", "kind", "line"] + STRING_FIELDS + INT_FIELDS + DOUBLE_FIELDS

_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT_TEXT = r"^\s*[+-]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


_CORRUPT = "_corrupt_record"


def _schema() -> str:
    fields = ["type"] + STRING_FIELDS + INT_FIELDS + DOUBLE_FIELDS + [_CORRUPT]
    return ", ".join(f"`{f}` string" for f in fields)


def _int_value(t: Column) -> Column:
    """32-bit integer from a number or from integer text (surrounding white
    space and a sign allowed); null otherwise (``1.5``, ``1e2``, overflow)."""
    return F.when(t.rlike(_INT_TEXT), strip_ws(t).try_cast("int"))


def _double_value(t: Column) -> Column:
    """Double from a number or number text (thousands commas allowed)."""
    return F.when(t.rlike(_FLOAT_TEXT), F.regexp_replace(strip_ws(t), ",", "").try_cast("double"))


def parse_event_lines(lines: DataFrame, line_col: str = "line", order_col: str = "line_no",
                      keep: list[str] | None = None) -> DataFrame:
    """S4.  Typed events from NDJSON text rows.

    Blank lines are skipped.  A line that is not JSON becomes ``kind='unparsed'``
    (kept as a log line).  JSON that is not an object, or an object without
    ``type``, is ignored.  ``kind`` is the lower-cased ``type``.  Missing or
    unreadable numbers are null (the carry-forward rule fills them later).
    ``keep`` names columns to take along, such as the run that wrote the line.

    Each line is parsed once (``from_json`` with every protocol field read as
    text); scalar values keep their JSON text, so the number rules apply to
    numbers and to number text alike.  Only lines the parser rejects are
    parsed a second time, to tell bad JSON from non-object JSON.
    """
    keep = keep or []
    src = lines.select(*keep, F.col(order_col).alias("line_no"), F.col(line_col).alias("line"))
    src = src.filter(F.length(strip_ws("line")) > 0)
    j = F.from_json("line", _schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    src = src.select(*keep, "line_no", "line", j.alias("j"))
    kind = (F.when(F.col(f"j.{_CORRUPT}").isNotNull(),
                   F.when(F.try_parse_json("line").isNull(), F.lit("unparsed")))
            .when(F.col("j.type").isNotNull(), F.lower("j.type")))
    src = src.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    unparsed = F.col("kind") == "unparsed"
    cols = [*map(F.col, keep), F.col("line_no"), F.col("kind"), F.col("line")]
    cols += [F.when(~unparsed, F.coalesce(F.col(f"j.{f}"), F.lit(""))).alias(f) for f in STRING_FIELDS]
    cols += [_int_value(F.col(f"j.{f}")).alias(f) for f in INT_FIELDS]
    cols += [_double_value(F.col(f"j.{f}")).alias(f) for f in DOUBLE_FIELDS]
    return src.select(*cols)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """S4 from NDJSON files.  ``line_no`` increases with the position in a file
    (not dense).  A run's log is one file; for several files whose order
    matters, read them into a table with an explicit order column and use
    ``parse_event_lines``."""
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_event_lines(raw.withColumnRenamed("value", "line"))


def to_event_json(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """One ASCII-escaped JSON object per row: ``{"type": kind, <fields>}``."""
    obj = F.struct(F.lit(kind).alias("type"), *[F.col(f) for f in fields])
    return df.select(F.to_json(obj, {"writeNonAsciiCharacterAsCodePoint": "true"}).alias("value"))


def write_event_log(df: DataFrame, path: str, kind: str, fields: list[str], mode: str = "overwrite") -> None:
    """S5.  Write rows as NDJSON text, non-ASCII as ``\\uXXXX`` escapes."""
    to_event_json(df, kind, fields).write.mode(mode).text(path)
