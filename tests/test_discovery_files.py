"""Discovery sources as files: formats, failing sources, batch and stream."""

import os

from addrgraph.plans import queries as Q
from addrgraph.plans.fixtures import fixture
from addrgraph.session import scratch_path
from addrgraph.sources.discovery import load_discovery
from addrgraph.sources.discovery_files import read_discovery_files, stream_discovery_files

from conftest import SF_SMALL


def local(spark, name):
    path = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def test_files_equal_the_table(spark):
    top = Q.source_folder(spark, SF_SMALL)
    want = load_discovery(fixture(spark, SF_SMALL, "discovery")).filter("source <> 'nosuch'")
    records, errors = read_discovery_files(spark, top)
    assert sorted(map(tuple, records.collect())) == sorted(map(tuple, want.collect())) and errors.count() == 0
    some, _ = read_discovery_files(spark, top, [" THC ", "nosuch"])
    assert {r.source for r in some.collect()} == {"thc"}


def test_a_failing_source_is_alone(spark):
    top = local(spark, "failing")
    with open(f"{top}/crtsh.json", "w") as f:
        f.write('{"kind": "host", "value": "a.example.com"}\n\n{"kind": "HOST", "value": 7}\n')
    with open(f"{top}/thc.json", "w") as f:
        f.write('{"kind": "host", "value": "b.example.com"}\n{broken\n')
    with open(f"{top}/rapiddns.parquet", "wb") as f:
        f.write(b"not parquet")
    with open(f"{top}/duckduckgo.txt", "w") as f:
        f.write("no reader for this\n")
    with open(f"{top}/CommonCrawl.csv", "w") as f:
        f.write('kind,value\nemail,"x@example.com\n"\n')
    with open(f"{top}/evil.json", "w") as f:
        f.write('{"kind": "host", "value": "never.example.com"}\n')
    records, errors = read_discovery_files(spark, top)
    got = sorted((r.source, r.kind, r.value) for r in records.collect())
    assert got == [("commoncrawl", "email", "x@example.com\n"), ("crtsh", "host", "7"), ("crtsh", "host", "a.example.com")]
    log = {r.source: r.message for r in errors.collect()}
    assert set(log) == {"thc", "rapiddns"} and log["thc"].startswith("source error (thc): thc.json: ")


def test_no_files(spark):
    top = local(spark, "nothing")
    for path in (top, top + "/absent"):
        records, errors = read_discovery_files(spark, path)
        assert records.count() == 0 and errors.count() == 0


def test_stream_takes_each_file_once(spark):
    top, work = local(spark, "arriving"), local(spark, "work")

    def run():
        q = (stream_discovery_files(spark, top).writeStream.format("parquet").option("path", work + "/out")
             .option("checkpointLocation", work + "/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        rows = spark.read.parquet(work + "/out").collect()
        return sorted((r.source, r.value or "", r.error is not None) for r in rows)

    with open(f"{top}/crtsh.json", "w") as f:
        f.write('{"kind": "host", "value": "a"}\n')
    assert run() == [("crtsh", "a", False)]
    with open(f"{top}/thc.csv", "w") as f:
        f.write("kind,value\nhost,b\n")
    with open(f"{top}/rapiddns.json", "w") as f:
        f.write("broken")
    assert run() == run() == [("crtsh", "a", False), ("rapiddns", "", True), ("thc", "b", False)]
