"""Every operator against a brute-force version, on awkward rows and on a small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, score double"


def awkward():
    base = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \t\n", "One", "one", "ONE two three four", base, base.upper(), base + " tail", base, "é" * 40 + " ß x  y ",
             LONG, LONG + " end", 'token = "abcdef123456" <|endoftext|> x', "a\x00b c", "###!!! ###!!!", "trailing  \n blank \n"]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(6, base, "en", "s1"), (6, base, "en", "s1"), (None, base, None, None), (None, None, None, None), (40, LONG, "en", "s1")]
    rows += [(100 + i, "copied words stand in many rows of this table again", "en", "s0") for i in range(40)]
    return [(*r, None, "x", "y", 1.0) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def known(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_exact_groups(spark, docs, none):
    from addrgraph.llm.dedup import drop_exact_copies, exact_groups

    groups = defaultdict(list)
    for i, t in known(docs):
        groups[t.translate(FOLD)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for bucket_bytes in (12 << 20, 64):
        rows = exact_groups(docs, bucket_bytes=bucket_bytes).collect()
        sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        assert Counter((r.doc_id, sha[r.text_sha256]) for r in rows) == Counter((i, t) for t, ids in groups.items() for i in ids)
        assert all(r.keep_id == best[sha[r.text_sha256]] and r.group_size == len(groups[sha[r.text_sha256]]) for r in rows)
        assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(list(sha))
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.text or "").translate(FOLD) for r in kept.collect()) == Counter(list(groups))
    assert exact_groups(none).count() == 0 and drop_exact_copies(none).count() == 0


def removed(docs, length=50):
    """Brute force: (id, bytes, removed, spans, digest) in order of id, equal ids at once."""
    by_id, out, seen = defaultdict(list), [], set()
    for i, t in docs:
        by_id[i].append(t.encode())
    for i in sorted(by_id, key=lambda i: (i is None, i)):
        new = set()
        for t in by_id[i]:
            mask = bytearray(len(t))
            for k in range(len(t) - length + 1):
                s = t[k:k + length]
                new.add(s)
                if s in seen:
                    mask[k:k + length] = b"\1" * length
            spans = sum(1 for k in range(len(t)) if mask[k] and not (k and mask[k - 1]))
            out.append((i, len(t), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(t, mask) if not m)).hexdigest()))
        if i is not None:
            seen |= new
    return Counter(out)


def test_drop_repeats(spark, docs, none):
    from addrgraph.llm.suffixes import drop_repeats

    texts = known(docs)
    for sizes in ({}, {"chunk_bytes": 3000, "bucket_bytes": 3000, "shard_bytes": 500}):
        rows = drop_repeats(docs, **sizes).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == removed(texts)
    assert drop_repeats(none).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = drop_repeats(table, chunk_bytes=20_000, bucket_bytes=50_000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == removed(known(table))


def test_a_passage_of_all_documents_is_divided(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc

    from addrgraph.llm import suffixes

    rng = np.random.default_rng(2)
    own = lambda: bytes(rng.integers(97, 123, 60, np.uint8)).decode()
    passage = "the same notice stands in every document of this table, between words of its own; " * 2
    texts = [(i, own() + passage + own()) for i in range(300)]
    sorted_bytes, judge = [], suffixes.smallest_owner
    monkeypatch.setattr(suffixes, "smallest_owner", lambda s, *more: sorted_bytes.append(sum(map(len, s))) or judge(s, *more))
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
        ([i for i, _ in texts], [i for i, _ in texts], [t.encode() for _, t in texts]), (pa.int64(), pa.int64(), pa.binary()))], ["row", "doc_id", "text"])
    shard_bytes = 2000
    chunks = list(suffixes._chunked(20_000)([batch]))
    lists = pa.Table.from_batches(list(suffixes._list_anchors(0, 50, 20)(chunks)))
    told = suffixes._shared_anchors(shard_bytes // 80)(lists)
    by = lambda t, c: t.filter(pc.equal(t["chunk"], c))
    chunks = pa.Table.from_batches(chunks)
    names = chunks["chunk"].to_pylist()
    assert len(names) > 3
    sent = pa.concat_tables([suffixes._send_segments(0, 50, 20)(by(chunks, c), by(told, c)) for c in names])
    judged = suffixes._judge_segments(50, 20, shard_bytes)(sent)
    assert max(sorted_bytes, default=0) <= 2 * shard_bytes
    apply = suffixes._apply(0, 50, 20, False)
    rows = [r for c in names for r in apply(by(chunks, c), pa.concat_tables([by(told, c), by(judged, c)])).to_pylist()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == removed(texts)


def test_suffix_array():
    from addrgraph.llm.suffixes import permuted_prefixes, suffix_array

    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        sa = suffix_array(x).tolist()
        assert sa == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        plcp = permuted_prefixes(x, np.array(sa))
        for a, b in zip(sa, sa[1:]):
            p, q = x[a:].tolist(), x[b:].tolist()
            assert plcp[b] == next((k for k, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))


def test_suffix_arrays_are_sorted_by_arrays():
    """A shard costs a few sorts of its size, not a Python step a byte."""
    import time

    from addrgraph.llm.suffixes import suffix_array

    rng = np.random.default_rng(7)
    words = [rng.integers(3, 30, 60) for _ in range(50)]
    text = np.concatenate([np.append(words[i][rng.integers(0, 10):], 1) for i in rng.integers(0, 50, 4000)])
    order = rng.permutation(len(text)).astype(np.uint64)

    def seconds(f, *a):
        times = []
        for _ in range(3):
            t = time.process_time()
            f(*a)
            times.append(time.process_time() - t)
        return min(times)

    assert seconds(suffix_array, text) < 10 * seconds(lambda x: np.argsort(x, kind="stable"), order)


def test_smallest_owners_come_in_runs():
    from addrgraph.llm.suffixes import smallest_owner

    rng = np.random.default_rng(6)
    for _ in range(60):
        segments = [bytes(rng.integers(97, 99, rng.integers(5, 30), np.uint8)) for _ in range(rng.integers(1, 12))]
        owners = rng.integers(-3, 9, len(segments)).tolist()
        strings = [(i, k, s[k:k + 5]) for i, s in enumerate(segments) for k in range(len(s) - 4)]
        want = {(i, k): min(owners[j] for j, _, u in strings if u == t) for i, k, t in strings}
        runs = list(zip(*(c.tolist() for c in smallest_owner(segments, owners, 5))))
        got = [((i, first + k), low) for i, first, n, low in runs for k in range(n)]
        assert len(got) == len(want) and dict(got) == want
        assert all(a[0] != b[0] or a[3] != b[3] for a, b in zip(runs, runs[1:]))  # as few as there can be


def test_anchors_are_picked_by_block():
    from addrgraph.llm.suffixes import anchors

    rng = np.random.default_rng(8)
    for _ in range(100):
        sizes = rng.choice([0, 1, 49, 50, 51, 80, 300], rng.integers(1, 8)).astype(np.int64)
        data = rng.integers(97, 97 + rng.integers(1, 5), sizes.sum(), dtype=np.uint8)
        whole = anchors(data, sizes, 50, 20, 1 << 20)
        for block in (1, 37, 64):
            assert all((a == b).all() for a, b in zip(whole, anchors(data, sizes, 50, 20, block)))
        hashed, first, last, doc, place = whole
        covered = [(d, k) for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()) for k in range(a, b + 1)]
        starts = (np.cumsum(sizes) - sizes).tolist()
        assert covered == [(d, starts[d] + k) for d, n in enumerate(sizes.tolist()) for k in range(n - 49)]
        assert ((first <= place) & (place + 20 <= first + 50) & (last <= place)).all()


def test_secrets(spark, docs, none):
    from addrgraph.llm.secrets import scan_secrets

    cases = {
        1: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', 2: "secret: token = abcdefgh", 3: "api_key=ab password: hunter22!",
        4: "AKIA" + "A" * 20 + " AKIAshort", 5: "0123456789abcdef01234567 0123", 6: "user: alice\nkey aB3" + "dE5" * 12,
        7: "user: alice\n\nkey aB3" + "dE5" * 12, 8: "user: alice and https://example.org/x", 9: None, 10: "",
        11: "login=bob password=secret99 host: db.example.org", 12: "PASSWORD=é password='abcdefg'"}
    rows = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, text in cases.items():
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (i, rows[i].spans, line)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(filter(None, line.split(","))) <= set(rows[i].spans.split(","))
    kinds = {i: {s.split(":")[0] for s in r.spans.split(",") if s} for i, r in rows.items()}
    assert kinds[6] == {"name", "key"}  # both parts in one paragraph
    assert kinds[7] == set() and kinds[8] == set()  # apart, or without a secret
    assert kinds[11] == {"name", "assign", "endpoint"}
    long, safe, token = "aB3" + "dE5" * 49, "aB3_dE5-" * 5, "ghp_" + "aB3dE5" * 6
    far = "user: alice " + "words " * 300 + "key " + "aB3" + "dE5" * 12
    jwt = ".".join(["eyJ" + "hB3" * 12, "eyJ" + "zU5" * 15, "Qx9_" * 11])
    more = {20: f"access_key_id=alice key {long}", 21: f"access_key_id=alice key {safe}", 22: f"login: bob {token}", 23: far,
            24: "password=aaaaaa " * 0 + "".join(f"secret=hunter{k}22 " for k in range(20)) + f"token={'aB3' + 'dE5' * 12} user: bob",
            25: f"login: bob\n{jwt}"}
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",")] for r in scan_secrets(df).collect()}
    for i, key in ((20, long), (21, safe), (22, token), (23, "aB3" + "dE5" * 12)):
        at = more[i].index(key)
        assert ["key", str(at), str(at + len(key))] in spans[i] and any(k == "name" for k, _, _ in spans[i]), (i, spans[i])
    assert not any(k == "key" for k, _, _ in spans[24])  # inside an assignment, after however many others
    assert sum(k == "key" for k, _, _ in spans[25]) == 3
    near = {r.doc_id: r.spans for r in scan_secrets(df, reach=400).collect()}
    assert near[23] == "" and near[20] != ""
    assert scan_secrets(docs).count() == docs.count() and scan_secrets(none).count() == 0


@pytest.mark.parametrize("reach", [None, 0, 7, 40])
def test_linked_spans_equal_an_interval_join(reach):
    """Every part held against every other of the text."""
    import random

    from addrgraph.llm import secrets as S

    r = random.Random(4)
    key = lambda: r.choice(["aB3", "Zx9_", "Qq-7"]) * r.choice([8, 11, 12, 40])
    piece = [lambda: "user: al" + str(r.randrange(99)), lambda: "client_id=abc", lambda: f"password={key()}", lambda: "secret: hunter22",
             key, lambda: "AKIA" + "Q7" * 9, lambda: "0af3" * 8, lambda: "https://db.example.org/x", lambda: "host: h.example.org",
             lambda: "plain words", lambda: "\n\n", lambda: "\n \t\n", lambda: "\n"]
    linked = 0
    for _ in range(400):
        text = "".join(r.choice(piece)() + r.choice([" ", "  ", "\n"]) for _ in range(r.randrange(1, 14)))
        base, weak = S.base_spans(text), S.weak_spans(text)
        bounds = [0, *(m.start() for m in re.finditer(r"\n[ \t]*\n", text)), len(text)]

        def together(a, b):
            at = max(i for i, x in enumerate(bounds[:-1]) if i == 0 or x <= a[0])
            low, high = bounds[at], bounds[at + 1]
            if reach is not None:
                low, high = max(low, a[0] - reach), min(high, a[1] + reach)
            return b[0] < high and b[1] > low

        need = {"name": ["secret"], "key": ["identifier"], "endpoint": ["identifier", "secret"]}
        want = [w for w in weak if not any(b[0] <= w[0] and w[1] <= b[1] for b in base)
                and all(any(S.ROLE[p[2]] == role and together(w, p) for p in [*base, *weak]) for role in need[w[2]])]
        assert sorted(S.link_parts(text, base, weak, reach)) == sorted(want), text
        linked += len(want)
    assert linked > 100


def test_shards(spark, docs, none):
    from addrgraph.llm.shards import shuffle_into_shards

    def look(rows, n, shards):
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        counts = [len(by[s]) for s in range(shards)]
        assert sum(counts) == n and max(counts) - min(counts) <= 1

    rows = shuffle_into_shards(docs, 8, block_bits=2, cell_rows=3).collect()
    look(rows, docs.count(), 8)
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in known(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert shuffle_into_shards(none).count() == 0
    many = spark.range(0, 3000, 1, 4).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = shuffle_into_shards(many, 7, block_bits=5, cell_rows=100).collect()
    look(rows, 3000, 7)
    # places say nothing about ids: rank correlation within a shard is small
    own = sorted((r.slot, r.doc_id) for r in rows if r.shard == 0)
    assert abs(np.corrcoef(np.array(own).T)[0, 1]) < 0.2


def test_hypergeometric_draws(spark):
    from pyspark.sql import functions as F

    from addrgraph.llm.common import uniform
    from addrgraph.llm.shards import hypergeometric

    for total, marked, draws in ((100, 30, 20), (10, 10, 4), (7, 3, 7), (10_000_000, 3_000_000, 65_536)):
        h = hypergeometric(uniform(F.lit(3), F.col("id")), F.lit(total), F.lit(marked), F.lit(draws))
        got = np.array([r.h for r in spark.range(20_000).select(h.alias("h")).collect()])
        p = marked / total
        var = draws * p * (1 - p) * (total - draws) / max(1, total - 1)
        assert abs(got.mean() - draws * p) <= 5 * (var / 20_000) ** 0.5 + 1e-9
        assert abs(got.var() - var) <= 0.06 * var + 1e-9
        assert got.min() >= max(0, draws + marked - total) and got.max() <= min(draws, marked)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_packing(spark, docs, none):
    from addrgraph.llm.packing import pack_documents

    path, tokenizer = library()
    for df, settings in ((docs, {}), (docs, {"part_pieces": 8}), (spark.read.parquet(f"{SF}/documents.parquet"), {"part_pieces": 50})):
        rows = pack_documents(df, path, **settings).collect()
        want = Counter()
        for i, t in known(df):
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
            start, length, piece = 0, (len(ids) - 1) % 2048 + 1, 0
            while start < len(ids):
                want[i, piece, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())] += 1
                start, length, piece = start + length, 2048, piece + 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
        parts = -(-len(rows) // settings.get("part_pieces", 65_536))
        assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + parts
    assert pack_documents(none, path).count() == 0


def test_packing_bounds_what_a_worker_holds(spark, monkeypatch):
    """Whole texts reach Python some hundred rows at a time, and an encoder remembers a bounded number of pieces."""
    import public_tokenizers

    from addrgraph.llm import packing as P
    from addrgraph.llm.tokens import encoder

    pieces = P._pieces

    def bounded(*args):
        inner = pieces(*args)

        def run(batches):
            def checked():
                for b in batches:
                    assert len(b) <= 500, len(b)
                    yield b

            return inner(checked())

        return run

    monkeypatch.setattr(P, "_pieces", bounded)
    rows = spark.range(1300).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    path, before = public_tokenizers.path("byte_bpe_50k.json"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert P.pack_documents(rows, path).count() == 1300
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    few, many = encoder(path, "ranks", 7), encoder(path, "ranks")
    text = " ".join(f"w{i}x" for i in range(60))
    assert few.ids(text) == many.ids(text) and len(few._ids) <= 7 < len(many._ids)


def test_scored_texts_are_moved_once(spark, docs):
    """A text that is a string already goes to Python inside its row only; others are cast."""
    from addrgraph.llm.quality import score

    plan = score(docs, None)._jdf.queryExecution().analyzed().toString()
    assert "coalesce" not in plan
    binary = docs.selectExpr("doc_id", "cast(text as binary) as text")
    assert score(binary, None).count() == docs.count() == score(docs, None).count()


def test_packing_exchanges_until_no_bin_is_saved(spark, monkeypatch):
    from addrgraph.llm import packing

    rng = np.random.default_rng(8)
    texts = [(i, " ".join(["a"] * int(n))) for i, n in enumerate(rng.integers(1, 11, 2000))]
    bins, packed = [], packing._packed

    def counted(pieces, *settings):
        out = packed(pieces, *settings)
        bins.append((pieces.select("sequence_id").distinct().count() if "sequence_id" in pieces.columns else None,
                     out.select("sequence_id").distinct().count()))
        return out

    monkeypatch.setattr(packing, "_packed", counted)
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, library()[0], capacity=20, part_pieces=6).collect()
    assert len(rows) == len(texts)
    lengths = np.array([r.length for r in rows])
    n = len({r.sequence_id for r in rows})
    assert n == packing.bin_bound(lengths, 20) or bins[-1][1] >= bins[-1][0], bins


def test_certified_partitions_keep_their_bins(spark, monkeypatch):
    """What is exchanged first are bins of partitions with a gap only."""
    from addrgraph.llm import packing

    rng = np.random.default_rng(4)
    texts = [(i, " ".join(["a"] * int(n))) for i, n in enumerate(rng.choice([3, 5, 6, 8, 9, 12], 900))]
    calls, packed = [], packing._packed

    def seen(pieces, *settings):
        calls.append((pieces.columns, pieces.where("bins <= bound").count() if "bins" in pieces.columns else None,
                      pieces.where("full").count() if "full" in pieces.columns else None))
        return packed(pieces, *settings)

    monkeypatch.setattr(packing, "_packed", seen)
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, library()[0], capacity=20, part_pieces=40).collect()
    assert len(rows) == len(texts) and len(calls) > 1
    assert calls[1][1] == 0  # no certified partition's
    assert all(c[2] == 0 for c in calls[1:])  # and never a full bin


def test_bin_bound():
    from itertools import count

    from addrgraph.llm.packing import best_fit_decreasing, bin_bound

    def fewest(sizes, capacity):
        sizes = sorted(sizes, reverse=True)

        def fits(i, free):
            if i == len(sizes):
                return True
            for f in set(free):
                if f >= sizes[i]:
                    rest = list(free)
                    rest[rest.index(f)] -= sizes[i]
                    if fits(i + 1, rest):
                        return True
            return False

        return next(n for n in count(1) if fits(0, [capacity] * n))

    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = rng.integers(1, 21, rng.integers(1, 8))
        best = fewest(sizes.tolist(), 20)
        assert bin_bound(sizes, 20) <= best <= len(best_fit_decreasing(sizes, 20)[2])


def test_token_counts(spark, docs, none, tmp_path):
    from addrgraph.llm.token_counts import count_tokens, read_cache

    path, tokenizer = library()
    cache = str(tmp_path / "cache")
    want = Counter((i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in known(docs))
    for _ in range(2):  # the second run finds everything stored
        assert Counter(map(tuple, count_tokens(docs, path, cache).collect())) == want
        stored = read_cache(spark, cache)
        assert stored.count() == len({t for _, t in known(docs)})
    assert count_tokens(none, path, cache).count() == 0


def test_piecewise_encoding_equals_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from addrgraph.llm.tokens import TextEncoder

    path, tokenizer = library()
    encoders = [TextEncoder(path, m) for m in ("library", "ranks")]

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from(list("ab'sZ9 \n\t  \x1c\x00.é中#")) | st.characters(codec="utf-8"), max_size=40))
    def same(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        for e in encoders:
            assert np.frombuffer(e.ids(text), "<u4").tolist() == ids and e.count(text) == len(ids)

    same()
    for text in ("x <|endoftext|> y<|endoftext|>", "a  b", " lead", "tail ", "it's we'll"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert all(np.frombuffer(e.ids(text), "<u4").tolist() == ids for e in encoders)


def test_shingle_hashes_of_neighbours_are_their_own():
    """A text's hashes don't depend on the texts it is hashed with, and shorter ones have one shingle of all their words."""
    from addrgraph.llm.shingles import LETTER, shingle_hashes, shingle_sets

    texts = [t.encode() for t in ("", "a", " A\t", "a b c d", "a b c d e", "a b c d e f", "B", "b\nc  d\x0be A b c", "é", "\x1f x")] * 3
    hashes, offsets = shingle_hashes(texts)
    assert LETTER[ord("A")] == LETTER[ord("a")] and np.diff(offsets).tolist() == [0, 1, 1, 1, 1, 2, 1, 3, 1, 1] * 3
    for k, t in enumerate(texts):
        assert hashes[offsets[k]:offsets[k + 1]].tolist() == shingle_hashes([t])[0].tolist()
    own = {t: s.tolist() for t, s in zip(texts, shingle_sets(texts))}
    assert own[b"a"] == own[b" A\t"] and all(s == sorted(set(s)) for s in own.values())
    assert own[b"a b c d e"][0] in own[b"a b c d e f"] and not set(own[b"a b c d"]) & set(own[b"a b c d e"])


def test_pieces_beyond_the_memory_are_encoded_together():
    """A full memory stays, and a text's other pieces take one call."""
    from addrgraph.llm.tokens import TextEncoder

    path, tokenizer = library()
    e = TextEncoder(path, "ranks", 7)
    calls, apart = [], e._plain
    e._plain = lambda pieces: calls.append(len(pieces)) or apart(pieces)
    for k in range(3):
        words = [f"w{i}x{k} né{i}é 中文{i}\tz{k}" for i in range(60)]
        for text in (" ".join(words), " ".join([*words, "<|endoftext|>", "end"]), "  ".join(words), " ".join(words) + "\u2003 x"):
            assert np.frombuffer(e.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e._ids) == 7 and calls[0] == 173 and len(calls) == 6


def shingled(text):
    w = WORD.findall(text.translate(FOLD))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def near_expected(texts):
    sets = [shingled(t) for _, t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(len(sets), links)
    least = {}
    for (i, _), c in zip(texts, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return Counter((i, len(s), least.get(c) if s else i) for (i, _), s, c in zip(texts, sets, comp))


def test_near_groups(spark, docs, none):
    from addrgraph.llm.shingles import keep_one_of_each_group, near_groups

    chain = [f"v{i}" for i in range(80)]
    rows = [(1000 + k, " ".join(chain[2 * k:2 * k + 50])) for k in range(12)]  # linked in a chain only
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df, settings in ((more, {}), (more, {"block_rows": 3, "most_heavy": 1, "groups": 4, "least_share": 2}), (table, {"least_share": 0})):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(df, **settings).collect())
        assert got == near_expected(known(df))
    assert near_groups(none).count() == 0
    kept = keep_one_of_each_group(docs)
    # of the group of a null id another stays; a null id without a shingle links with nothing
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id is null").count() == 1


def test_one_of_each_group_stays(spark):
    """Repeated and null ids: no text goes without one of its group."""
    from addrgraph.llm.shingles import keep_one_of_each_group

    word = lambda k: " ".join(f"{k}{i}" for i in range(60))
    base, other, lone = word("a"), word("b"), word("c")
    rows = [(1, base), (2, base + " tail"), (2, lone), (None, other), (None, other + " tail"), (None, other + " end"),
            (5, word("d")), (5, word("d") + " x"), (6, word("e")), (6, word("e")), (8, None), (8, ""), (None, " ")]
    df = spark.createDataFrame([(*r, "en", "s", 1, None, "x", None) for r in rows], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in keep_one_of_each_group(df).collect())
    least = min([other, other + " tail", other + " end"], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    first = min([word("d"), word("d") + " x"], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert got == Counter([(1, base), (2, lone), (None, least), (5, first), (6, word("e")), (6, word("e")), (8, None), (8, ""), (None, " ")])


def test_group_around_one_text(spark):
    """Copies that link with their base only: stars find it; the same with the tree alone."""
    import random

    from addrgraph.llm.shingles import near_groups

    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for at in r.sample(range(0, 200, 6), 3):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    want = near_expected(rows)
    assert sum(k[2] == 0 for k in want) == 120
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for settings in ({}, {"least_share": 2, "block_rows": 30}):
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(df, **settings).collect()) == want


def test_taken_words_by_hand(spark, docs):
    """Words taken of each row, from the drawn slots and the places of its words, one by one."""
    from addrgraph.llm.mixing import block_times, mix, source_targets

    rows, pieces = mix(docs, block_words=16)
    rows = rows.collect()
    taken = Counter()
    for p in pieces.collect():
        taken[p.row] += (p["to"] - p["from"]) * p.times
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    targets = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    slots = block_times(targets, 8, 16, 3, 8).collect()
    times = Counter((s.source, s.block) for s in slots)
    blocks = {s: -(-n // 16) for s, n in sizes.items()}
    assert all(0 <= b < blocks[s] for s, b in times)
    for source, n in blocks.items():  # every block as often as any other, or once more
        own = [times[source, b] for b in range(n)]
        assert not own or max(own) - min(own) <= 1 and max(own) <= 3
    place = Counter()
    for r in sorted((r for r in rows), key=lambda r: r.start):
        assert r["size"] == 0 or r.start == place[r.source]
        place[r.source] += r["size"]
        assert taken[r.row] == sum(times[r.source, w // 16] for w in range(r.start, r.start + r["size"]))


def test_rtree_loses_no_pair():
    from addrgraph.llm.shingles import RTree

    rng = np.random.default_rng(7)
    points = rng.poisson(3, (300, 16))
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, 16)) * (rng.random((150, 16)) < 0.1), 0)
    found = {(int(a), int(b)) for q, p in RTree(points, 8).candidates(points, 80) for a, b in zip(q, p)}
    total = points.sum(1)
    both = np.minimum(points[:, None], points[None]).sum(2)
    want = 180 * both >= 80 * (total[:, None] + total[None])
    assert {(int(a), int(b)) for a, b in np.argwhere(want)} <= found


def test_mix(spark, docs, none):
    from addrgraph.llm.mixing import mix, mixed_documents

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    rows, pieces = mix(table)
    rows, pieces = rows.collect(), pieces.collect()
    taken = Counter()
    for p in pieces:
        taken[p.row] += (p["to"] - p["from"]) * p.times
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= taken[r.row] <= 3 * r["size"]
        own = by[r.source]
        own[0] += r["size"]
        own[1] += taken[r.row]
        own[2] = r.target
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - total) < 1e-3
    assert all(abs(v[1] - v[2]) <= 0.05 * v[2] for v in by.values())
    ids = {r.row: r.doc_id for r in rows}
    once = Counter({ids[row]: n for row, n in taken.items()})
    # other orders, partitions and numbers of shuffle partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for df, shuffles in ((table.repartition(7), "8"), (table.orderBy("n_chars").coalesce(1), "3"), (table.repartition(2, "lang"), "1")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            again, numbered = Counter(), None
            numbered, got = mix(df)
            numbered = {r.row: r.doc_id for r in numbered.collect()}
            for p in got.collect():
                again[numbered[p.row]] += (p["to"] - p["from"]) * p.times
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert again == once
    sizes = Counter((i, len(WORD.findall(t))) for i, t in known(docs))
    assert Counter((r.doc_id, r["size"]) for r in mix(docs)[0].collect()) == sizes
    assert mix(none)[0].count() == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    rows, pieces = mix(docs)
    want = pieces.selectExpr("sum((to - from) * times)").first()[0]
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == want and mixed_documents(none).count() == 0


def test_targets_by_hand(spark):
    from addrgraph.llm.mixing import source_targets

    def by_rounds(sizes):
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
        total, fixed = float(sum(sizes.values())), {}
        while True:
            left = [s for s in names if s not in fixed]
            unit = (total - sum(fixed.values())) / sum(weight[s] for s in left) if left else 0
            over = [s for s in left if unit * weight[s] > 3 * sizes[s] + 1e-9]
            if not over:
                return {s: fixed.get(s, unit * weight[s]) for s in names}
            fixed |= {s: 3.0 * sizes[s] for s in over}

    for sizes in ({"a": 100, "b": 1, "c": 1, None: 500}, {"a": 10}, {"a": 0, "b": 5, "é": 7}, {f"s{i}": (i * 7919) % 100 for i in range(30)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got == pytest.approx(by_rounds(sizes)), sizes


def test_permutation(spark):
    from pyspark.sql import functions as F

    from addrgraph.llm.mixing import permuted

    for n in (1, 2, 7, 100, 1001):
        for key in (1, 2):
            got = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key)).alias("p")).collect()]
            assert sorted(got) == list(range(n))


def test_attention_by_hand():
    """Scores from loops over passages, and the gradient from differences of the loss."""
    from addrgraph.llm import quality as Q

    rng = np.random.default_rng(3)
    sizes, y = [3, 1, 4, 2], np.array([1.0, 0, 1, 0])
    x, starts = rng.normal(0, 1, (10, Q.MEASURES)), np.array([0, 3, 4, 8])
    model = Q.AttentionModel(hidden=4, gate=3)
    model.w = {k: rng.normal(0, 0.3, v.shape) for k, v in model.w.items()}
    w = model.w

    def by_hand():
        out = []
        for a, n in zip(starts, sizes):
            h = [np.tanh(p @ w["E"] + w["e"]) for p in x[a:a + n]]
            s = [float(np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"]))) @ w["a"]) for v in h]
            alpha = np.exp(s) / np.exp(s).sum()
            out.append(float(1 / (1 + np.exp(-(sum(k * v for k, v in zip(alpha, h)) @ w["c"] + w["b"][0])))))
        return np.array(out)

    assert np.allclose(model.score(x, starts), by_hand())
    # one step of fit moves each weight against the sign of its gradient
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - model.mean) / model.scale
    loss = lambda: -np.mean(y * np.log(by_hand()) + (1 - y) * np.log(1 - by_hand()))
    slopes = {}
    for k, at in (("E", (5, 1)), ("e", (2,)), ("V", (1, 2)), ("U", (3, 0)), ("a", (1,)), ("c", (2,)), ("b", (0,))):
        keep = w[k][at]
        w[k][at] = keep + 1e-5
        up = loss()
        w[k][at] = keep - 1e-5
        slopes[k, at] = (up - loss()) / 2e-5
        w[k][at] = keep
    before = {k: v.copy() for k, v in w.items()}
    raw = x * model.scale + model.mean
    model.fit(raw, starts, y, steps=1, rate=0.01, decay=0.0)
    for (k, at), slope in slopes.items():
        assert np.isclose(before[k][at] - model.w[k][at], 0.01 * np.sign(slope), atol=1e-4), (k, slope)


def test_training_takes_whole_bags(spark, monkeypatch):
    """Every passage of a sampled document; repeated ids count once; the bounds hold."""
    from addrgraph.llm import quality as Q

    seen = []
    monkeypatch.setattr(Q.AttentionModel, "fit", lambda self, x, starts, y: seen.append((len(x), list(starts), list(y))) or self)
    rows = [(i, " ".join(["w"] * (100 * (i + 1)))) for i in range(12)] + [(3, "other text")] * 5 + [(None, "no id"), (20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (5, None), (4, 0), (20, 1)], "doc_id long, quality int")
    Q.train(df, labels)
    n, starts, y = seen.pop()
    sizes = sorted(np.diff([*starts, n]).tolist())
    assert len(y) == 13 and sizes in (sorted([*range(1, 13), 1]), sorted([1, 2, 3, 1, *range(5, 13), 1]))
    Q.train(df, labels, most_passages=20)
    n, starts, y = seen.pop()
    assert n <= 20
    Q.train(df, labels, most_documents=4)
    assert len(seen.pop()[2]) == 4


def test_quality(spark, docs, none):
    from addrgraph.llm.quality import held_out, score, train

    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = train(table, labels.where(~held_out(labels["doc_id"])))
    rows = score(table, model).select("doc.doc_id", "score").join(labels, "doc_id").where(held_out(labels["doc_id"])).collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.95
    scored = score(docs, model)
    assert scored.select("doc.*").columns == docs.columns
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == docs.count()
    assert score(none, model).count() == 0
    assert train(docs, labels.limit(0)) is None and {r.score for r in score(docs, None).collect()} == {0.5}


def test_vectors(spark):
    from addrgraph.llm.vectors import vector_groups

    rng = np.random.default_rng(10)
    x = rng.standard_normal((600, 16))
    x[300:400] = x[:100] + 0.05 * rng.standard_normal((100, 16))
    x[400:560] = x[7] + 0.02 * rng.standard_normal((160, 16))  # one dense group
    x = x.astype(np.float32)
    x[560:] = x[3]  # and one of copies
    rows = [(i, [float(v) for v in r], int(i % 2) if i < 300 else int((i - 300) % 100 % 2) if i < 400 else 1, "n") for i, r in enumerate(x)]
    rows += [(600, None, 1, "n"), (601, [0.0] * 16, 1, "n"), (602, [None] * 16, 1, "n"), (603, [float("nan")] * 16, 1, "n"),
             (604, rows[3][1], None, "n"), (None, rows[3][1], 1, "n"), (605, [1.0, 2.0], 1, "n"), (606, [], 1, "n"), (3, rows[3][1], 1, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string").repartition(4)
    every = df.collect()
    usable = [r.embedding is not None and len(r.embedding) > 0 and all(v is not None and np.isfinite(v) for v in r.embedding)
              and any(r.embedding) and r.label is not None for r in every]
    links, n = [], [0] * len(every)
    unit = [np.array(r.embedding, float) / np.linalg.norm(r.embedding) if ok else None for r, ok in zip(every, usable)]
    for a in range(len(every)):
        for b in range(a):
            if usable[a] and usable[b] and every[a].label == every[b].label and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    comp = components(len(every), links)
    least = {}
    for r, c in zip(every, comp):
        if r.vec_id is not None:
            least[c] = min(r.vec_id, least.get(c, r.vec_id))
    want = Counter((r.vec_id, n[k], least.get(c)) for k, (r, c) in enumerate(zip(every, comp)))
    for settings in ({}, {"task_points": 150, "leaf": 40, "trees": 8}):
        got = vector_groups(df, **settings).collect()
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
        found = sum(r.n_links for r in got)
        assert len(got) == len(every) and 0.9 * sum(n) <= found <= sum(n)
        if not settings:
            assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert vector_groups(df.limit(0)).count() == 0


def test_links_of_a_tight_group_are_linear(spark):
    """1 500 vectors that are all linked: their links are counted, not listed."""
    from pyspark.sql import functions as F

    from addrgraph.llm.vectors import forest_links, vector_groups

    rng = np.random.default_rng(2)
    n = 1500
    x = rng.normal(0, 1, 32) + rng.normal(0, 0.05, (n, 32))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<float>")
    points = df.select(F.col("vec_id").alias("row"), "label", F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("copies"))
    links, connecting, counted = forest_links(points, 0.93, 6, 256, 0.9, 8192, 10)
    assert links.count() + connecting.count() <= 3 * n and counted.count() == n
    got = vector_groups(df).collect()
    assert all(r.n_links == n - 1 and r.component_id == 0 for r in got)


def test_recall_just_above_the_threshold(spark):
    """Pairs at 0.93 to 0.95 between many unrelated vectors, with the production settings."""
    from addrgraph.llm.vectors import vector_groups

    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(0, 1, (600, 64))
    side -= (side * base[:600]).sum(1, keepdims=True) * base[:600]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.95, (600, 1))
    x = np.concatenate([base, cos * base[:600] + np.sqrt(1 - cos * cos) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_groups(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (y @ y.T >= 0.93).sum(1) - 1
    assert all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.97 * want.sum() and want.sum() >= 1200


def test_vectors_of_a_group_larger_than_a_task(spark):
    from addrgraph.llm.vectors import vector_groups

    rng = np.random.default_rng(11)
    x = rng.standard_normal((2400, 16))
    x[:1200] = x[0] + 0.25 * rng.standard_normal((1200, 16))  # a third of its pairs or so link
    x[1200:1500] = x[1200] + 0.01 * rng.standard_normal((300, 16))
    x = x.astype(np.float32)
    x[1500:1520] = x[3]  # copies count as often as they stand there
    df = spark.createDataFrame([(i, r.tolist(), i // 1600) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.arange(len(x)) // 1600
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    comp = np.array(components(len(x), np.argwhere(hit).tolist()))
    for task_points in (100, 700):  # nodes compared whole below the root, and at the root
        got = {r.vec_id: r for r in vector_groups(df, task_points=task_points, leaf=32).collect()}
        n = np.array([got[i].n_links for i in range(len(x))])
        assert (n <= hit.sum(1)).all() and n.sum() >= 0.98 * hit.sum(), n.sum() / hit.sum()
        assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) >= 0.98


def test_components(spark):
    from addrgraph.llm.common import connected_components

    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(600, [e for e in edges if e[0] != e[1]])
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
