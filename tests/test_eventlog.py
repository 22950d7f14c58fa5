import pytest

from addrgraph.operators.eventlog import COUNTERS, carry_forward, event_log_summary, keep_last_lines
from addrgraph.sources.eventlog import parse_event_lines


def _ev(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    return parse_event_lines(df)


def test_parse_kinds_and_numbers(spark):
    ev = _ev(spark, ['{"type":"Progress","processed_pages":"7","failed_pages":1.5,"queue_length":3}',
                     "", "  ", "oops", "[1,2]", '{"x":1}',
                     '{"type":"summary","duration_seconds":"1,000.5","total_email_hits":2147483648}',
                     '{"type":"email","email":5,"source_url":null}'])
    rows = {r["line_no"]: r for r in ev.collect()}
    assert sorted(rows) == [0, 3, 6, 7]
    assert rows[0]["kind"] == "progress" and rows[0]["processed_pages"] == 7
    assert rows[0]["failed_pages"] is None and rows[0]["queue_length"] == 3
    assert rows[3]["kind"] == "unparsed"
    assert rows[6]["duration_seconds"] == 1000.5 and rows[6]["total_email_hits"] is None
    assert rows[7]["email"] == "5" and rows[7]["source_url"] == ""


def test_carry_and_summary(spark):
    ev = _ev(spark, ['{"type":"progress","processed_pages":3,"queue_length":4}',
                     '{"type":"progress","failed_pages":1}',
                     '{"type":"summary","processed_pages":9,"duration_seconds":-2}',
                     '{"type":"progress","processed_pages":"x"}'])
    cf = [tuple(r) for r in carry_forward(ev).orderBy("line_no").collect()]
    assert cf == [(0, 3, 0, 0, 0, 4, ""), (1, 3, 1, 0, 0, 0, ""), (3, 9, 1, 0, 0, 0, "")]
    s = event_log_summary(ev).collect()[0]
    assert (s["processed_pages"], s["failed_pages"], s["duration_seconds"], s["saw_summary"]) == (9, 1, 0.0, True)


def test_retention(spark):
    df = spark.range(0, 1300).withColumnRenamed("id", "line_no")
    kept = keep_last_lines(df)
    assert kept.count() == 1000 and kept.agg({"line_no": "min"}).first()[0] == 300
    assert keep_last_lines(spark.range(0, 1200).withColumnRenamed("id", "line_no")).count() == 1200


def interleaved(spark, n=3000):
    """A log of runs "big" (a third of all lines), others, and one without a name; run "quiet" only logs."""
    rows = []
    for i in range(n):
        run = "big" if i % 3 == 0 else None if i % 50 == 1 else "quiet" if i % 50 == 2 else f"r{i * 7 % 40}"
        kind = "log" if run == "quiet" else ["progress", "progress", "summary", "email"][(i * 5) % 4 if i % 100 else 2]
        fields = [f'"{c}":{(i * (k + 3)) % 997}' for k, c in enumerate(COUNTERS) if (i + k) % 3 == 0]
        fields += ['"failed_pages":"x"'] if i % 7 == 0 and i % 3 else []
        rows.append((run, (i * 1103) % 4001, "{" + ",".join([f'"type":"{kind}"', '"message":"m"', f'"queue_length":{i}', *fields]) + "}"))
    return spark.createDataFrame(rows, "run string, line_no long, line string").repartition(4), rows


def simulate(rows):
    """Line by line: progress rows, and each run's last state."""
    import json

    out, state, ends = [], {}, {}
    for run, no, line in sorted(rows, key=lambda r: r[1]):
        e = json.loads(line)
        now = state.setdefault(run, dict.fromkeys(COUNTERS, 0))
        ends.setdefault(run, 0)
        if e["type"] in ("progress", "summary"):
            now.update({c: e[c] for c in COUNTERS if isinstance(e.get(c), int)})
            ends[run] += e["type"] == "summary"
        if e["type"] == "progress":
            out.append((run, no, *now.values(), e["queue_length"], ""))
    return out, {r: (*s.values(), ends[r] > 0) for r, s in state.items()}


@pytest.mark.parametrize("rows_per_bucket", [40, None])
def test_runs_are_kept_apart(spark, rows_per_bucket):
    df, rows = interleaved(spark)
    ev = parse_event_lines(df, keep=["run"])
    want, last = simulate(rows)
    got = [tuple(r) for r in carry_forward(ev, rows_per_bucket, run_col="run").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 1000
    summary = {r["run"]: (*(r[c] for c in COUNTERS), r["saw_summary"]) for r in event_log_summary(ev, "run").collect()}
    assert summary == last and summary["quiet"] == (0, 0, 0, 0, False)
