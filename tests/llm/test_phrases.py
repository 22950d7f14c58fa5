"""Removal of repeated passages against a brute-force version."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from test_operators import SCHEMA, awkward

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, length=50):
    by_id, out, seen = defaultdict(list), [], set()
    for i, t in docs:
        by_id[i].append(WORD.findall(t or ""))
    for i in sorted(by_id, key=lambda i: (i is None, i)):
        new = set()
        for words in by_id[i]:
            gone = [False] * len(words)
            for k in range(len(words) - length + 1):
                w = tuple(words[k:k + length])
                new.add(w)
                if w in seen:
                    gone[k:k + length] = [True] * length
            kept = " ".join(w for w, g in zip(words, gone) if not g)
            out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        if i is not None:
            seen |= new
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def texts(seed=7):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "Beta", "γάμμα", "d", "e-e", "😀", "zeta,", "H", "iota", "kappa"]) + str(r.randrange(40))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 60, 90, 200, 400)]
    gaps = [" ", "  ", "\n", "\t \x0b", "\r\n", "\x0c"]
    out = []
    for i in range(160):
        words = some(r.randrange(0, 120))
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 40))
            words += p[a:] if r.random() < .5 else p[:len(p) - a]
            if r.random() < .3:  # a near copy
                words[r.randrange(len(words))] = "changed"
            words += some(r.randrange(0, 60))
        out.append("".join(w + r.choice(gaps) for w in words))
    same = passages[4] + passages[4]
    out += [" ".join(same)] * 3 + [" ".join(["la"] * n) for n in (49, 50, 70, 300)] + ["\x85 ".join(passages[3]), None, "", " \n"]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 6) for i, t in rows], SCHEMA).repartition(5)


def test_passages_equal_brute_force(spark):
    from addrgraph.llm.phrases import drop_repeated_passages

    ids = list(range(0, 1000))
    random.Random(3).shuffle(ids)
    rows = list(zip(ids, texts()))
    want = brute(rows)
    assert sum(k[2] > 0 for k in want) > 60 and sum(k[2] == 0 for k in want) > 60
    df = table(spark, rows)
    assert result(drop_repeated_passages(df)) == want
    small = drop_repeated_passages(df, chunk_bytes=3000, bucket_bytes=4000, shard_words=500)  # divided phrases, many shards
    assert result(small) == want
    assert result(drop_repeated_passages(df, length=12, gram=4, chunk_bytes=20_000, shard_words=3000)) == brute(rows, 12)


def test_awkward_rows(spark):
    from addrgraph.llm.phrases import drop_repeated_passages

    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = drop_repeated_passages(df, with_text=True)
    assert result(out) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())
    assert drop_repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_passages(df, gram=50)


def test_common_phrase_in_every_context(spark):
    """Ten words that every document has, each time between other words, and one common passage."""
    from addrgraph.llm.phrases import drop_repeated_passages

    r = random.Random(1)
    common, passage = [f"c{i}" for i in range(10)], [f"p{i}" for i in range(70)]
    rows = []
    for i in range(400):
        own = [f"w{r.randrange(10**6)}" for _ in range(120)]
        rows.append((i, " ".join(own[:60] + common + own[60:] + (passage if i % 3 == 0 else []))))
    want = brute(rows)
    assert result(drop_repeated_passages(table(spark, rows), shard_words=2000, chunk_bytes=40_000)) == want
    assert sum(k[2] for k in want) == 133 * 70


def test_confirm_and_locate():
    from addrgraph.llm.phrases import _letter, confirmed, located

    groups = [{"abcdefgh": (1, 4)}, {"xxpqrstuyy": (2, 2), "zzpqrstuww": (5, 5), "mmpqrstvww": (3, 9)}, {"lonely": (7, 7)}]
    found = confirmed(groups, 4)
    assert found["abcdefgh"] == 1 and found["pqrstu"] == 2 and all(found[p] <= 3 for p in found) and "lonely" not in found
    for text, hits in zip(["__pqrstu__", "abcdefghi", "pqrs"], located(found, ["__pqrstu__", "abcdefghi", "pqrs"])):
        brute_hits = sorted((text.index(p), len(p), o) for p, o in found.items() if p in text)
        assert sorted(hits) == brute_hits
    assert located({}, ["a", "b"]) == [[], []]
    letters = [_letter(i) for i in range(70_000)]
    assert len(set(letters)) == 70_000 and not any("\ud800" <= x <= "\udfff" for x in letters)


def test_words_in_texts():
    from addrgraph.llm.phrases import words_in

    parts = [b"ab  cd", b"", b" \n", b"ab", b"cd ab\x0bx"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin, end, hashed, n = words_in(data, np.array([len(p) for p in parts]))
    words = [data[a:e].tobytes() for a, e in zip(begin, end)]
    assert words == [b"ab", b"cd", b"ab", b"cd", b"ab", b"x"] and n.tolist() == [2, 0, 0, 1, 3]
    assert len(set(hashed.tolist())) == 3 and hashed[0] == hashed[2] == hashed[4]
