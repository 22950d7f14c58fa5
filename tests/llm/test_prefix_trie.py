"""The prefix trie against a plain one in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long, weight string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(parts)


def brute(rows, group=100):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    nodes, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / group) * group
        seq = tuple(own.get(c - base, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
            if d:
                kids[seq[:d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = Counter(), Counter()
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] += not kids[s]
        saved[s] += (len(nodes[s]) - 1) * (len(s[-1][1]) if s else 0)
        if s:
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    return Counter((min(cs), len(s), min(nodes[s[:-1]]) if s else None, len(cs), len(kids[s]), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, cs in nodes.items())


def result(df):
    from addrgraph.llm.prefix_trie import COLUMNS

    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def awkward():
    rows = []
    for c in [*range(0, 40), *range(95, 140), 200, 250, 251, 333, -5, -100, -250, 10**12 + 7]:
        n = c % 7
        for t in range(n):
            rows.append((c, t if t != 2 else None, ["user", "assistant", None][t % 3], [None, "", "hi", "où ça 😀", "x" * 50][(c * t) % 5]))
    rows += [(300, i % 2, "user", "same") for i in range(6)] + [(301, 1, "user", "same")] * 3  # repeated numbers and rows
    rows += [(None, 0, "user", "of nobody"), (None, None, None, None)]
    rows += [(500 + i, t, "r", f"common {t}") for i in range(60) for t in range(7)]  # copies
    rows += [(600, t, "r", f"common {t}") for t in range(9)] + [(700, t, "ab", "c") for t in range(3)] + [(701, t, "a", "bc") for t in range(8)]
    return rows


def test_trie_equals_brute_force(spark):
    from addrgraph.llm.prefix_trie import prefix_trie

    rows = awkward()
    assert result(prefix_trie(table(spark, rows))) == brute(rows)


def test_long_conversation_is_spread(spark, monkeypatch):
    """A conversation that holds most rows, longer than a block and than a range."""
    from addrgraph.llm import prefix_trie as P

    monkeypatch.setattr(P, "BLOCK", 5)
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(100, t, "u", f"t{t % 30}") for t in range(700)] + [(200, t, "u", f"t{t % 30}") for t in range(400)]
    rows += [(300 + i, t, "u", f"t{t % 30}") for i in range(90) for t in range(6)] + [(c, t, "u", "z" * c) for c in range(30) for t in range(3)]
    assert result(P.prefix_trie(table(spark, rows))) == brute(rows)


def test_empty_and_turnless(spark):
    from addrgraph.llm.prefix_trie import prefix_trie

    assert prefix_trie(table(spark, [])).count() == 0
    lone = [(150, 0, "u", "t")]  # crc32("150") % 6 turns are taken from conversation 100, which is absent
    assert result(prefix_trie(table(spark, lone))) == brute(lone)
    few = [(c, 0, "u", "t") for c in range(101, 130)]
    assert result(prefix_trie(table(spark, few))) == brute(few)
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in brute(few))


def test_scratch_is_deleted(spark):
    import os

    from addrgraph.llm.prefix_trie import prefix_trie
    from addrgraph.session import checkpoint_dir

    top = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    prefix_trie(table(spark, awkward()))
    assert [x for x in os.listdir(top) if x not in before and "trie-result" not in x] == []
