"""The pipeline's stages, each on its own input, and the registered queries."""

import re
from collections import Counter, defaultdict

from test_operators import FOLD, WORD, known, near_expected

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    from addrgraph.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
        else:
            assert docs.agg({"length": "sum"}).first()[0] > seen[name].count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in known(seen["exact_dedup"])}
    assert all(i in kept for i, q in labels.items() if q == 1)
    groups = defaultdict(list)
    for i, t in known(seen["exact_dedup"]):
        groups[t.translate(FOLD)].append(i)
    assert sorted(i for i, _ in known(seen["near_dedup"])) == sorted(max(v) for v in groups.values())
    expected = near_expected(known(seen["near_dedup"]))
    assert sorted(i for i, _ in known(seen["mixing"])) == sorted(i for i, _, c in expected if i == c)
    words = Counter()
    for i, t in known(seen["mixing"]):
        words[i] += len(WORD.findall(t))
    taken = Counter()
    for i, t in known(seen["packing"]):
        taken[i] += len(WORD.findall(t))
    assert all(taken[i] <= 3 * words[i] for i in taken)


def test_queries_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    # what has no SQL twin, and is held against brute force in these folders instead
    without = {n for n in names if n not in entry.oracle_sql()}
    assert without == {n for n in names if re.match(r"op([2-9]|10)_", n)} | {"pipeline"}


def awkward_folder(spark, rows, labels):
    from addrgraph.session import scratch_path

    top = scratch_path(spark, "awkward")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, node string, score double")
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_awkward_rows_through_all_stages(spark):
    """Nulls, repeated ids and rows, long and empty texts, columns that clash; nothing is labelled bad."""
    import corpus_pipeline
    from addrgraph.llm.common import written
    from test_operators import awkward

    top = awkward_folder(spark, awkward(), [(1, 1, 0), (None, 1, 0), (2, None, 0)])
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, top), name)
        assert name == "packing" or docs.columns == columns
    assert Counter(known(seen["exact_dedup"])) == Counter(known(seen["quality"]))  # no model, so all stay
    texts = {t.translate(FOLD) for _, t in known(seen["quality"])}
    assert sorted(t.translate(FOLD) for _, t in known(seen["near_dedup"])) == sorted(texts)
    left = Counter(known(seen["mixing"]))
    groups = near_expected(known(seen["near_dedup"]))
    # of each group of near copies one, and all without a shingle
    least = {c for _, n, c in groups.elements() if n and c is not None}
    assert least <= {i for i, _ in left} and all(n == 1 for n in left.values())
    assert sum(not WORD.findall(t) for _, t in left) == sum(not WORD.findall(t) for _, t in known(seen["near_dedup"]))
    assert all(WORD.findall(t) for _, t in known(seen["packing"]))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= {i for i, _ in left}


def test_empty_tables_through_all_stages(spark):
    import corpus_pipeline

    top = awkward_folder(spark, [], [])
    assert corpus_pipeline.run(spark, top).count() == 0
