"""File sources and sinks: NDJSON round trip (S5 -> S4) and the CSV export (S7)."""

import csv
import glob
import os
import tempfile

import pytest

from addrgraph.operators.report import email_report
from addrgraph.sources.eventlog import read_event_log, write_event_log
from addrgraph.sources.export import EmptyReportError, export_report_csv


def test_event_log_round_trip(spark):
    rows = [(1, "é@x.org", "https://h/é"), (2, "b@y.org", "https://h/2")]
    df = spark.createDataFrame(rows, "page_id long, email string, source_url string")
    out = os.path.join(tempfile.mkdtemp(), "log")
    write_event_log(df.coalesce(1), out, "email", ["email", "source_url"])
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(out, "part-*"))))
    assert "\\u00E9" in text and "é" not in text
    ev = read_event_log(spark, out)
    got = sorted((r["kind"], r["email"], r["source_url"]) for r in ev.collect())
    assert got == [("email", "b@y.org", "https://h/2"), ("email", "é@x.org", "https://h/é")]


def test_export_quoting_and_order(spark):
    hits = spark.createDataFrame(
        [(1, 'https://h/a"b', "B@x.org"), (2, "https://h/a,b", "a@x.org"), (3, "", "c@x.org")],
        "page_id long, source_url string, email string")
    out = os.path.join(tempfile.mkdtemp(), "csv")
    export_report_csv(email_report(hits), out, single_file=True)
    (part,) = glob.glob(os.path.join(out, "part-*.csv"))
    lines = open(part, encoding="utf-8").read().splitlines()
    assert lines[0] == "Email,Hits,FirstSeen,LastSeen,SourceUrl"
    assert lines[1] == 'a@x.org,1,,,"https://h/a,b"'
    assert lines[2] == 'B@x.org,1,,,"https://h/a""b"'
    assert lines[3] == "c@x.org,1,,,"
    assert [r[0] for r in csv.reader(lines[1:])] == ["a@x.org", "B@x.org", "c@x.org"]


def test_export_refuses_empty(spark):
    empty = spark.createDataFrame([], "page_id long, source_url string, email string")
    with pytest.raises(EmptyReportError):
        export_report_csv(email_report(empty), os.path.join(tempfile.mkdtemp(), "csv"))
