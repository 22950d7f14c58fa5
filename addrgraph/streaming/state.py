"""Keyed state that lives between micro-batches: carried counters and the retained log.

Each run of a log is a key of Spark's state store.  What a key keeps is bounded (four
counters; at most ``LOG_LIMIT_LINES`` lines), whatever the length of its log.  The functions
are sent to the executors by value, which need no copy of this package.
"""

from __future__ import annotations

import heapq
import sys
from collections import deque
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from addrgraph.operators.eventlog import COUNTERS, LOG_KEEP_LINES, LOG_LIMIT_LINES, log_messages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CARRIED = ", ".join(f"{c} int" for c in COUNTERS)
PROGRESS = f"run string, line_no long, {CARRIED}, queue_length int, current_url string"
RETAINED = "run string, appended long, length int, first_line_no long, lines array<struct<line_no: long, message: string>>"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CarryForward(StatefulProcessor):
    """Counters of a run: a field that is missing keeps its last value, 0 at the start."""

    def __init__(self, counters: list[str], state: str):
        self.counters, self.state = counters, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counters", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = list(self.held.get()) if self.held.exists() else [0] * len(self.counters)
        for r in sorted(rows, key=lambda r: r["line_no"]):
            now = [b if (a := r[c]) is None else a for c, b in zip(self.counters, now)]
            if r["kind"] == "progress":
                yield Row(run=key[0], line_no=r["line_no"], **dict(zip(self.counters, now)),
                          queue_length=r["queue_length"] or 0, current_url=r["current_url"])
        self.held.update(tuple(now))

    def close(self) -> None:
        pass


def stream_carry_forward(events: DataFrame, run_col: str = "run_id") -> DataFrame:
    """W2 as events arrive: one row per ``progress`` event with its run's counters carried.

    ``events`` is a stream of typed events (S4) with the run of each line.  Lines of a run
    are taken in the order of ``line_no`` within a micro-batch and micro-batches as they
    come; a task holds a run's progress and summary lines of one micro-batch, whose size the
    source's options bound.  Append mode; the null run is named ``""``.
    """
    rows = events.filter(F.col("kind").isin("progress", "summary")).select(
        F.coalesce(F.col(run_col).cast("string"), F.lit("")).alias("run"), "line_no", "kind", *COUNTERS, "queue_length", "current_url")
    return rows.groupBy("run").transformWithState(CarryForward(COUNTERS, CARRIED), PROGRESS, "append", "none")


def retained_length(appended: int, limit: int = LOG_LIMIT_LINES, keep: int = LOG_KEEP_LINES) -> int:
    """Length of a log after ``appended`` lines, if it is cut to ``keep`` whenever it is longer than ``limit``."""
    return appended if appended <= limit else keep + (appended - limit - 1) % (limit + 1 - keep)


class RetainedLog(StatefulProcessor):
    """The lines that a log still shows, under retention on every append."""

    def __init__(self, limit: int, keep: int, length):
        self.limit, self.keep, self.length = limit, keep, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("appended", "n long")
        self.lines = handle.getListState("lines", "line_no long, message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.count.get()[0] if self.count.exists() else 0
        shown = deque((tuple(x) for x in self.lines.get()), self.limit) if before else deque(maxlen=self.limit)
        n, last = 0, []  # of the batch's lines only the last can still be shown
        for i, r in enumerate(rows):
            n += 1
            item = ((r["line_no"], i), r["message"])
            if len(last) < self.limit:
                heapq.heappush(last, item)
            else:
                heapq.heappushpop(last, item)
        shown.extend((at[0], message) for at, message in sorted(last))
        length = self.length(before + n, self.limit, self.keep)
        kept = list(shown)[len(shown) - length:]
        self.count.update((before + n,))
        self.lines.put(kept)
        yield Row(run=key[0], appended=before + n, length=length, first_line_no=kept[0][0],
                  lines=[Row(line_no=a, message=b) for a, b in kept])

    def close(self) -> None:
        pass


def stream_retained_log(events: DataFrame, run_col: str = "run_id", limit: int = LOG_LIMIT_LINES,
                        keep: int = LOG_KEEP_LINES) -> DataFrame:
    """L6 as lines arrive: the log of each run that a micro-batch changed, with its length.

    Retention applies on every append, as if the lines came one by one: above ``limit``
    lines only the last ``keep`` stay.  Update mode: a run's newest row is its log.
    """
    run = F.coalesce(F.col(run_col).cast("string"), F.lit("")).alias("run")
    rows = log_messages(events, keep=[run]).select("run", "line_no", "message")
    return rows.groupBy("run").transformWithState(RetainedLog(limit, keep, retained_length), RETAINED, "update", "none")


def start_keyed(spark: SparkSession, start):
    """Call ``start()`` with the state store that keyed state needs; the session's setting stays as it was."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(_STORE, before)
