"""Merkle manifest and octopus proofs against a plain tree in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from test_operators import SCHEMA, awkward

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([sha("".join(n[i:i + 2])) for i in range(0, len(n), 2)])
    return levels


def brute(rows):
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        bad = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
            bad = leaf_of(doc_id, source, lang, n_chars + 1, text)
        trees[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, bad))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: climb([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    top = climb([built[x][-1][0] for x in langs]) if langs else None
    out = []
    for place, lang in enumerate(langs):
        for at, (_, _, leaf, doc_id, bad) in enumerate(sorted(trees[lang], key=lambda t: t[:3])):
            node, kin = bad or leaf, []
            for levels, i in ((built[lang], at), (top, place)):
                for level in levels[:-1]:
                    if i ^ 1 < len(level):
                        kin.append(level[i ^ 1])
                        node = sha(level[i ^ 1] + node if i & 1 else node + level[i ^ 1])
                    else:
                        node = sha(node)
                    i >>= 1
            root = top[-1][0]
            out.append((doc_id, leaf, built[lang][-1][0], root, sha("".join(kin)), node, node == root))
    return Counter(out)


def results(df):
    return Counter(tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Trees of 1, 2, 3, 4, 600 and more leaves; repeated rows and ids, nulls in every column."""
    rows = [(i, t, ["en", "fr", None][i % 3] if i is not None else "", s, None if (i or 0) % 5 == 4 else len(t or "")) for i, t, _, s, *_ in awkward()]
    rows += [(1000 + i, f"text {i % 50}", "en", None, 2**63 - 1 if i == 7 else i) for i in range(900)]
    rows += [(5, "a", "x", "s", 1), (7, "b", "y", "s", 1), (8, "c", "y", "s", 1), (9, "d", "z", None, 0), (9, "d", "z", None, 0), (10, "e", "z", "", 3)]
    rows += [(3000 + i, "t", "null", "s", 1) for i in range(4)]
    return spark.createDataFrame([(*r, None, "x", 1.0) for r in rows], SCHEMA).repartition(5).cache()


def test_proofs_equal_brute_force(spark, docs):
    from addrgraph.llm.merkle import build_manifest, prove

    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got, want = results(prove(build_manifest(docs))), brute(rows)
    assert got == want
    changed = sum(not k[-1] for k in got)
    assert 0 < changed < len(rows) / 3  # every altered row is found, no other


def test_proofs_of_some_leaves(spark, docs):
    """Few leaves of a partition: their proofs need nodes of every level, fetched once each."""
    from addrgraph.llm.merkle import build_manifest, prove

    manifest = build_manifest(docs)
    some = prove(manifest, manifest.leaves.where("idx % 97 in (3, 4)"))
    whole, part = results(prove(manifest)), results(some)
    assert 10 < sum(part.values()) < 60 and not part - whole


def test_octopus_asks_for_the_minimal_union():
    from addrgraph.llm.merkle import derive, fold, missing_nodes, path

    for n in (1, 2, 3, 5, 8, 13, 64, 100):
        levels = climb([sha(f"l{i}") for i in range(n)])
        for known in ([0], [n - 1], list(range(n)), list(range(0, n, 3)), [n // 2, n - 1]):
            wanted = missing_nodes(known, n)
            assert len(wanted) == len(set(wanted)) and all(i < len(levels[at]) for at, i in wanted)
            below = {(at, i >> at) for i in known for at in range(len(levels))}
            assert not below & set(wanted)  # nothing that its leaves give
            fetched = {(at, i): levels[at][i] for at, i in wanted}
            own = derive({i: levels[0][i] for i in known}, fetched, n)
            assert own[-1][0] == levels[-1][0]
            assert all(fold(levels[0][i], path(own, i, n)) == levels[-1][0] for i in known)
            for drop in fetched:  # without any one of them some proof fails
                with pytest.raises(KeyError):
                    partial = derive({i: levels[0][i] for i in known}, {k: v for k, v in fetched.items() if k != drop}, n)
                    [path(partial, i, n) for i in known]
    assert missing_nodes(range(16), 16) == []


def test_no_rows(spark):
    from addrgraph.llm.merkle import build_manifest, prove

    manifest = build_manifest(spark.createDataFrame([], SCHEMA))
    assert manifest.root is None and prove(manifest).count() == 0


def test_many_trees_and_a_tree_of_several_steps(spark):
    from addrgraph.llm.merkle import build_manifest, prove

    rows = [(i, f"t{i}", f"lang {i % 300}" if i % 3 else "hot", "s", 1) for i in range(3000)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert results(prove(build_manifest(df))) == brute([(i, s, lang, n, t) for i, t, lang, s, n in rows])
