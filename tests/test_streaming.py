"""Stream = batch: every streaming job equals its batch twin after availableNow."""

import pytest

from addrgraph.plans import queries as Q
from addrgraph.plans import streaming_queries as S

from conftest import SF_SMALL

PAIRS = [
    ("stream_email_hits", Q.extract_emails_site),
    ("stream_email_report", Q.email_report),
    ("stream_unique_emails", lambda s, d: Q.email_report(s, d).select("email")),
    ("stream_progress", lambda s, d: Q.crawl_summary(s, d).drop("duration_seconds")),
    ("stream_event_demux", lambda s, d: Q.read_event_log(s, d).filter("kind in ('email','progress','log','summary','unparsed')")),
]


@pytest.mark.parametrize("name,batch", PAIRS)
def test_stream_equals_batch(spark, name, batch):
    s = S.STREAM_QUERIES[name](spark, SF_SMALL)
    b = batch(spark, SF_SMALL)
    cols = [c for c in b.columns]
    a = sorted(map(tuple, s.select(*cols).collect()), key=repr)
    e = sorted(map(tuple, b.collect()), key=repr)
    assert a == e


def test_unique_with_watermark_bounds_state(spark):
    import os

    from addrgraph.plans.fixtures import fixture
    from addrgraph.session import checkpoint_dir
    from addrgraph.streaming import jobs as K

    hits = fixture(spark, SF_SMALL, "hits")
    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), "k3w")
    hits.repartition(3).write.parquet(os.path.join(work, "in"))
    src = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(work, "in"))
    q = (K.stream_unique_emails(src, watermark="365 days").select("email").writeStream.format("parquet")
         .option("path", os.path.join(work, "out")).option("checkpointLocation", os.path.join(work, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r[0] for r in spark.read.parquet(os.path.join(work, "out")).collect())
    # A watermark wider than the data keeps every address once.
    assert got == sorted(r[0] for r in hits.select("email").distinct().collect())


def _staged(spark, df, name, files):
    import os

    from addrgraph.session import checkpoint_dir
    from addrgraph.streaming import jobs as K

    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), name)
    df.repartition(files).write.parquet(os.path.join(work, "in"))
    return work, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(work, "in"))


def test_progress_over_several_batches(spark, monkeypatch):
    from pyspark.sql import DataFrameReader

    from addrgraph.plans.fixtures import fixture
    from addrgraph.streaming import jobs as K

    work, src = _staged(spark, fixture(spark, SF_SMALL, "site"), "k4m", 3)
    read, orig = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *p: (read.extend(p), orig(self, *p))[1])
    q = K.run_progress(src, work + "/out", work + "/ck")
    q.awaitTermination()
    monkeypatch.undo()
    # a batch reads nothing but the one row of the batch before
    assert [p.rsplit("=", 1)[1] for p in read] == [f"{e:012d}" for e in range(len(read))] and len(read) == 2
    want = Q.crawl_summary(spark, SF_SMALL).drop("duration_seconds").first()
    assert tuple(K.read_progress(spark, work + "/out/progress").select(*want.asDict()).first()) == tuple(want)


def test_report_is_merged_by_bucket(spark):
    """Buckets that a batch does not touch keep their files; old ones go; a replayed epoch changes nothing."""
    from addrgraph.plans.fixtures import fixture
    from addrgraph.streaming import jobs as K

    work, src = _staged(spark, fixture(spark, SF_SMALL, "hits"), "k2m", 5)
    K.run_email_report(src, work + "/out", work + "/ck", buckets=4).awaitTermination()
    want = Q.email_report(spark, SF_SMALL)
    current = lambda: sorted(map(tuple, K.read_report(spark, work + "/out").select(*want.columns).collect()))
    assert current() == sorted(map(tuple, want.collect()))
    table = K.KeyedTable(spark, work + "/out")
    assert len(table.epochs()) == 2  # of five
    table.merge(want.withColumn("hits", want["hits"] + 1), 4)
    assert current() == sorted(map(tuple, want.collect()))


def test_keyed_table(spark):
    import os

    from addrgraph.session import scratch_path
    from addrgraph.streaming.merge import KeyedTable

    path = scratch_path(spark, "keyed")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    table = KeyedTable(spark, path, ["k"], buckets=3)
    with pytest.raises(ValueError):
        table.read()
    table.merge(rows(), 0)
    want = {}
    for epoch in range(1, 9):
        batch = {k: epoch for k in ["a", None, f"k{epoch}", f"k{epoch // 2}"]}
        KeyedTable(spark, path, ["k"], buckets=7).merge(rows(*batch.items()), epoch)  # a restarted writer
        want |= batch
        got = table.read().collect()
        assert {r.k: r.n for r in got} == want and len(got) == len(want)
        table.merge(rows(("a", -1)), epoch)
        assert {r.k: r.n for r in table.read().collect()} == want
    files = [f for d, _, names in os.walk(path.removeprefix("file:") + "/data") for f in names if f.endswith(".parquet")]
    assert len(files) <= 14  # the buckets of two manifests, however many epochs there were
    # an epoch that failed before its manifest was renamed is written anew
    table.merge(rows(("z", 1)), 9)
    os.remove(os.path.join(path.removeprefix("file:"), "manifests", f"{9:012d}"))
    assert {r.k: r.n for r in table.read().collect()} == want
    table.merge(rows(("z", 2)), 9)
    assert {r.k: r.n for r in table.read().collect()} == want | {"z": 2}


def _run_stream(spark, lines, name, files):
    """``lines`` (run, line_no, line) in order as that many files, one a micro-batch."""
    import os

    from addrgraph.session import checkpoint_dir
    from addrgraph.sources.eventlog import parse_event_lines
    from addrgraph.streaming import jobs as K

    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), name)
    size = -(-len(lines) // files)
    schema = "run_id string, line_no long, line string"

    def add(part):
        spark.createDataFrame(lines[part * size:(part + 1) * size], schema).coalesce(1).write.mode("append").parquet(work + "/in")

    def src():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(work + "/in")
        return parse_event_lines(s, keep=["run_id"])

    return work, add, src


def test_live_carry_forward_and_restart(spark):
    from test_eventlog import interleaved, simulate

    from addrgraph.streaming import jobs as K

    lines = sorted(interleaved(spark, 900)[1], key=lambda r: r[1])
    work, add, src = _run_stream(spark, lines, "w2", 4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in range(4):
        add(part)
        if part:  # the first start sees two files, each later one a file more
            K.run_carry_forward(src(), work + "/out", work + "/ck").awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = [(r[0] or "", *r[1:]) for r in simulate(lines)[0]]
    assert sorted(map(tuple, spark.read.parquet(work + "/out").collect())) == sorted(want) and len(want) > 300


def test_live_retention(spark):
    """The length after each batch, and the lines, as if every line was appended alone."""
    from addrgraph.streaming import jobs as K
    from addrgraph.streaming.state import retained_length

    lines = [("a" if i % 4 else "b", i, f'{{"type":"log","message":"m{i}"}}' if i % 5 else f"text {i}") for i in range(3300)]
    work, add, src = _run_stream(spark, lines, "l6", 3)
    shown, told = {"a": [], "b": []}, []
    for part in range(3):
        add(part)
        K.run_retained_log(src(), work + "/out", work + "/ck").awaitTermination()
        for run, no, line in lines[part * 1100:(part + 1) * 1100]:
            shown[run].append((no, "[Scrapy] " + (line if line.startswith("text") else f"m{no}")))
            if len(shown[run]) > 1200:
                shown[run] = shown[run][-1000:]
        got = {r.run: [(x.line_no, x.message) for x in r.lines] for r in K.KeyedTable(spark, work + "/out").read().collect()}
        assert got == shown
        told.append({r.run: r.length for r in K.KeyedTable(spark, work + "/out").read().collect()})
    assert told[-1] == {k: len(v) for k, v in shown.items()} and told[-1]["a"] < 1200
    n, length = 0, 0
    for n in range(1, 5000):
        length = length + 1 if length < 1200 else 1000
        assert retained_length(n) == length


def test_observed_progress_over_batches_and_restart(spark):
    """The listener's table equals K4's after every batch; callbacks get the same; no job of its own."""
    import os

    from addrgraph.plans.fixtures import fixture
    from addrgraph.streaming.progress import run_observed

    from addrgraph.streaming import jobs as K
    from addrgraph.session import checkpoint_dir

    site = fixture(spark, SF_SMALL, "site")
    work = K.new_run_folder(os.path.join(checkpoint_dir(spark), "streams"), "k4o")
    told, lines, rows = [], [], [r.asDict() for r in site.collect()]

    def src():
        return spark.readStream.schema(site.schema).option("maxFilesPerTrigger", 1).parquet(work + "/in")

    for part in range(3):
        spark.createDataFrame(rows[part * 50:(part + 1) * 50], site.schema).coalesce(1).write.mode("append").parquet(work + "/in")
        if part != 1:  # two batches in the second start
            run = run_observed(src(), work + "/out", work + "/ck", f"observed-{part}", told.append, on_log=lines.append)
            last = run.wait()
            assert run.listener.error is None
    steps = []
    for n in (50, 100, 150):
        some = spark.createDataFrame(rows[:n], site.schema)
        steps.append(tuple(Q.R.crawl_summary(*(lambda s: (s, Q.X.extract_emails(s.filter("ok"))))(Q.X.split_fetchable(some)))
                           .select("processed_pages", "failed_pages", "unique_email_count", "total_email_hits").first()))
    got = [(p.processed_pages, p.failed_pages, p.unique_email_count, p.total_email_hits) for p in told]
    assert got == steps and tuple(last.__dict__.values())[1:] == steps[-1]
    table = sorted(tuple(r)[1:] for r in run.listener.log.read().collect())
    assert table == sorted(steps)
    firsts = spark.read.parquet(work + "/out/emails").collect()
    assert len(firsts) == len({r.email for r in firsts}) == steps[-1][2]
    assert any("started" in x for x in lines) and any("ended" in x for x in lines) and any("failed" in x for x in lines)


def test_observed_run_reports_failures_and_bad_callbacks(spark):
    from addrgraph.streaming.progress import run_observed

    schema = "page_id long, url string, html string, status int, content_type string"
    work, src = _staged(spark, spark.createDataFrame([(1, "https://h/", "a@b.example.com", 200, None)] * 3, schema), "k4f", 2)
    lines, batches = [], []

    def refuse(_):
        raise RuntimeError("no")

    run = run_observed(src, work + "/out", work + "/ck", "bad-callback", refuse,
                       lambda batch, epoch: batches.append((epoch, batch.count())), lines.append)
    assert run.wait().total_email_hits == 3 and isinstance(run.listener.error, RuntimeError)
    assert sum(n for _, n in batches) == 1

    def fail(batch, epoch):
        raise ValueError("sink is full")

    work, src = _staged(spark, spark.createDataFrame([(1, "https://h/", "a@b.example.com", 200, None)], schema), "k4g", 1)
    with pytest.raises(Exception, match="sink is full"):
        run_observed(src, work + "/out", work + "/ck", "bad-sink", None, fail, lines.append).wait()
