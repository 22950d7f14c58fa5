"""Documents that share most of their word shingles (count-vector R-tree).

Every pair at or above the similarity has one of its rarest shingles in common (prefix
filter: the first ``n - ceil(s n) + 1`` in one global order), so documents meet only in
the blocks of such shingles.  Blocks are joined in two steps:

1. Stars: each block's members are verified against one member, picked by hash; those that
   it does not link are held against the member with most links so far, and so on while
   rounds find links.  A round is linear in the members, and joins most groups of near copies.
2. Rest: in blocks that still hold more than one component, documents are points of
   shingle counts by hash group in an R-tree.  The sum of coordinate minima bounds the
   overlap from above, for a box as for a point; pairs that pass, on coordinates four
   together and then one by one, and lie in different components are verified on whole texts.

In a block, sizes and places bound the overlap too: of a pair whose first common shingle is
the block's, no shingle before it is common, so what each has from there on is the most.
A pair that another block's shingle rules out is looked at in the block of its first one.

Every link between different components is looked at, so components are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.session import scratch

from .common import connected_components, read, text_or_empty, written

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = FOLD.astype(np.uint64) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SLOTS = 1 << 20
#: Counts in one byte: exact up to 199, above rounded up to the next of 56 levels a third apart,
#: so a sum of minima of levels is still no smaller than the overlap.
LEVELS = np.concatenate([np.arange(200), np.ceil(200 * (4 / 3) ** np.arange(56))]).astype(np.int64)
_INT_LEVELS = LEVELS.astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006 - one table a process
    if base not in kept or len(kept[base]) < n:
        kept[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base % 2**64, np.uint64)])
    return kept[base][:n]


def shingle_hashes(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order, and where each text's begin (one more
    than texts).  A text of fewer words has one shingle; one without words has none."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    space = np.ones(len(data) + 2, bool)
    np.take(SPACE, data, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    value = LETTER[data]
    value *= _powers(BASE, len(data))
    np.cumsum(value, out=sums[1:])
    word = (sums[end] - sums[start]) * _powers(pow(BASE, -1, 2**64), len(data))[start]
    word = _mixed(word + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(start, begins)  # first word of each text
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], count)
    # of the shingle that begins at every word, whichever text the next words are of
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    total = word.copy()
    for k in range(1, words):
        total *= np.uint64(0x2545F4914F6CDD1D)
        total += padded[k:len(word) + k]
    total = total[at] + np.uint64(words)
    for text in np.flatnonzero((n > 0) & (n < words)).tolist():  # one shorter shingle
        short = 0
        for w in word[first[text]:first[text + 1]].tolist():
            short = (short * 0x2545F4914F6CDD1D + w) % 2**64
        total[offsets[text]] = (short + int(n[text])) % 2**64
    return _mixed(total), offsets


def _sliced(sizes: list[int], most: int = 1 << 20):
    """Index ranges of texts of about ``most`` bytes together."""
    i = 0
    while i < len(sizes):
        j, size = i, 0
        while j < len(sizes) and (j == i or size + sizes[j] <= most):
            size += sizes[j]
            j += 1
        yield i, j
        i = j


def _sizes(column) -> list[int]:
    return pa.compute.binary_length(column).to_pylist()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for i, j in _sliced([len(t) for t in texts]):
        hashes, offsets = shingle_hashes(texts[i:j])
        for k in range(j - i):
            own = np.sort(hashes[offsets[k]:offsets[k + 1]])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
    return out


def _buffers(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _slot_counts(batches):
    """How often each slot of shingle hashes is hit, where clearly more often than the average."""
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        for i, j in _sliced(_sizes(b.column(0))):
            hashes, _ = shingle_hashes(_buffers(b.column(0).slice(i, j - i)))
            counts += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    mean = counts.mean()
    often = np.flatnonzero(counts > mean + 4 * np.sqrt(mean) + 8)
    yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.array(counts[often], pa.int64())], ["slot", "n"])


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _profiles(heavy: np.ndarray, percent: int):
    is_heavy = np.zeros(SLOTS, bool)
    is_heavy[heavy] = True

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for whole in batches:
            for at, end in _sliced(_sizes(whole.column(2)), 4 << 20):  # a few MB of text at a time
                b = whole.slice(at, end - at)
                texts = _buffers(b.column(2))
                counts, digests, nodes, prefixes, blobs = [], [], [], [], []
                for text, own in zip(texts, shingle_sets(texts)):
                    n = len(own)
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None
                    node = n > 0 and digest not in seen
                    counts.append(n)
                    digests.append(digest)
                    nodes.append(node)
                    if node:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(digest)
                        # frequent shingles last, else in order of hash: any one order is right
                        late = is_heavy[(own % np.uint64(SLOTS)).astype(np.int64)]
                        ranked = np.concatenate([own[~late], own[late]])
                        prefixes.append(ranked[:n - _needed(n, percent) + 1].view(np.int64))
                        blobs.append(pack(text))
                    else:
                        prefixes.append(None)
                        blobs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(nodes, pa.bool_()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(blobs, pa.binary()), b.column(3)],
                    ["row", "doc_id", "n", "digest", "node", "prefix", "blob", "sha"])

    return run


def _verify(percent: int, pairs_at_once: int = 250):
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, len(whole), pairs_at_once):
                b = whole.slice(at, pairs_at_once)
                a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                where = {node: (2, i) for i, node in enumerate(a_ids)} | {node: (3, i) for i, node in enumerate(b_ids)}
                sets = dict(zip(where, shingle_sets([unpack(b.column(c)[i].as_py()) for c, i in where.values()])))
                keep = []
                for i, (x, y) in enumerate(zip(a_ids, b_ids)):
                    p, q = sets[x], sets[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in range(2)], ["a", "b"])

    return run


def _count_vectors(groups: int):
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                sets = shingle_sets([unpack(x.as_py()) for x in b.column(1)])
                fine = np.array([np.bincount((s >> np.uint64(40)) % np.uint64(groups), minlength=groups) for s in sets])
                codes = np.searchsorted(LEVELS, fine).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([row.tobytes() for row in codes], pa.binary())], ["node", "n", "fine"])

    return run


def _codes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of two arrays of codes, row by row; codes are in the order of their levels."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1024):
        out[at:at + 1024] = _INT_LEVELS[np.minimum(a[at:at + 1024], b[at:at + 1024])].sum(1)
    return out


class RTree:
    """Points packed into boxes by halving on the widest coordinate; a box keeps the largest
    value of each coordinate and the least total."""

    def __init__(self, points: np.ndarray, leaf: int = 24, totals: np.ndarray | None = None):
        self.points, self.totals, self.nodes = points, points.sum(1) if totals is None else totals, []
        self._build(np.arange(len(points)), leaf)

    def _build(self, at, leaf):
        me = len(self.nodes)
        own = self.points[at]
        high = own.max(0)
        self.nodes.append([high, self.totals[at].min(), self.totals[at].max(), at, None])
        if len(at) > leaf:
            widest = int(np.argmax(high - own.min(0)))
            order = at[np.argsort(own[:, widest], kind="stable")]
            half = len(order) // 2
            self.nodes[me][4] = (self._build(order[:half], leaf), self._build(order[half:], leaf))
        return me

    def candidates(self, queries: np.ndarray, percent: int, totals: np.ndarray | None = None):
        """(query, point) index arrays of all pairs the bound lets through."""
        totals = queries.sum(1) if totals is None else totals
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            high, least, most, at, children = self.nodes[node]
            # 100 both >= percent (x + y - both), and both is at most the sum of minima
            bound = np.minimum(queries[q], high).sum(1)
            q = q[((100 + percent) * bound >= percent * (totals[q] + least)) & (100 * most >= percent * totals[q])
                  & (100 * totals[q] >= percent * least)]
            if not len(q):
                continue
            if children:
                stack += [(child, q) for child in children]
                continue
            for p in at:
                bound = np.minimum(queries[q], self.points[p]).sum(1)
                hit = q[(100 + percent) * bound >= percent * (totals[q] + self.totals[p])]
                if len(hit):
                    yield hit, np.full(len(hit), p)


def _bound_hits(points: np.ndarray, totals: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int):
    """The pairs of points (x, y) that the bound lets through."""
    bound = np.minimum(points[x], points[y]).sum(1)
    hit = (100 + percent) * bound >= percent * (totals[x] + totals[y])
    yield x[hit], y[hit]


def _block_pairs(points: np.ndarray, totals: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Index arrays of the pairs of a block that the bound lets through: by hand if there are
    few, else through a tree over the right side."""
    if len(left) * len(right) <= 4096:
        yield from _bound_hits(points, totals, *(k.ravel() for k in np.meshgrid(left, right, indexing="ij")), percent)
        return
    tree = RTree(points[right], totals=totals[right])
    for q, p in tree.candidates(points[left], percent, totals[left]):
        yield left[q], right[p]


def _block_join(percent: int):
    """Candidate pairs between components in the blocks of one group of blocks.  Boxes and
    first bounds use coordinates four together; what leaves has passed the single ones."""
    def join(rows):
        rows = rows.sort_values(["token", "i", "j"], kind="stable", ignore_index=True)
        fine = _codes(rows.pop("fine"))  # kept as codes: a byte a coordinate
        points = np.concatenate([_INT_LEVELS[fine[at:at + 1024]].reshape(-1, fine.shape[1] // 4, 4).sum(2, dtype=np.int32)
                                 for at in range(0, len(fine), 1024)])
        nodes, comps, salts, i, j, token, totals = (rows[c].to_numpy() for c in ("node", "component", "salt", "i", "j", "token", "n"))
        onward = totals - rows["pos"].to_numpy()
        change = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.append(0, np.flatnonzero(change) + 1)
        sizes = np.diff(np.append(starts, len(rows)))
        two = starts[(sizes == 2) & (i[starts] == j[starts])]  # most blocks have two members
        two = two[comps[two] != comps[two + 1]]
        found = [np.empty((2, 0), np.int64)]

        def add(pairs):
            for x, y in pairs:
                other = np.flatnonzero((comps[x] != comps[y]) & (
                    (100 + percent) * np.minimum(onward[x], onward[y]) >= percent * (totals[x] + totals[y])))
                for at in range(0, len(other), 4096):
                    p, q = x[other[at:at + 4096]], y[other[at:at + 4096]]
                    hit = (100 + percent) * _overlap_bound(fine[p], fine[q]) >= percent * (totals[p] + totals[q])
                    found.append(np.stack([nodes[p[hit]], nodes[q[hit]]]))

        for at in range(0, len(two), 4096):
            add(_bound_hits(points, totals, two[at:at + 4096], two[at:at + 4096] + 1, percent))
        for start, size in zip(starts.tolist(), sizes.tolist()):
            own = np.arange(start, start + size)
            if i[start] != j[start]:
                add(_block_pairs(points, totals, own[salts[own] == i[start]], own[salts[own] == j[start]], percent))
            elif size > 2 and comps[own].min() != comps[own].max():
                add(_block_pairs(points, totals, own, own, percent))
        x, y = np.concatenate(found, axis=1)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return join


def _bound_filter(percent: int):
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                bound = _overlap_bound(*(_codes(b.column(c).to_pylist()) for c in (4, 5)))
                keep = (100 + percent) * bound >= percent * (b.column(2).to_numpy() + b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(np.flatnonzero(keep))) for c in range(2)], ["a", "b"])

    return run


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sum of coordinate minima allow the similarity."""
    p = points.select("node", "n", "fine")
    both = (pairs.join(p.withColumnsRenamed({"node": "a", "n": "m", "fine": "x"}), "a")
            .join(p.withColumnsRenamed({"node": "b", "fine": "y"}), "b")
            .where(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).select("a", "b", "m", "n", "x", "y"))
    return both.mapInArrow(_bound_filter(percent), "a long, b long")


def _verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    texts = active.select("node", "blob")
    both = (pairs.join(texts.withColumnsRenamed({"node": "a", "blob": "x"}), "a")
            .join(texts.withColumnsRenamed({"node": "b", "blob": "y"}), "b").select("a", "b", "x", "y"))
    return both.mapInArrow(_verify(percent), "a long, b long")


def _may_link(n, pos, m, at, percent: int) -> Column:
    """Whether sizes, and places of a first common shingle, allow two sets the similarity."""
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & ((100 + percent) * F.least(n - pos, m - at) >= percent * (n + m)))


def _star_links(met: DataFrame, points: DataFrame, active: DataFrame, percent: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """Links and looked-at pairs (a < b) of star rounds over blocks ``met`` (token, node, n, pos).

    The first hub of a block is picked by hash (eight choices, so that not all blocks of one
    group pick the same).  Members that their hub does not link meet the member with most
    links so far, as long as a round links ``least_share`` of the pairs it looks at."""
    pair = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
    first = F.min(F.struct(F.xxhash64("node", F.pmod("token", F.lit(8))).alias("h"), "node", "n", "pos"))
    best = F.max(F.struct("degree", F.xxhash64("node").alias("h"), "node", "n", "pos"))
    as_hub = lambda x: [x["node"].alias("hub"), x["n"].alias("m"), x["pos"].alias("at")]
    hubs = met.groupBy("token").agg(first.alias("x")).select("token", *as_hub(F.col("x")))
    left, links, seen = met, None, None
    while True:
        fits = _may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), percent)
        tried = written(left.join(hubs, "token").where("node <> hub").select("token", "node", "n", "pos", *pair, fits.alias("fits")), "tried")
        pairs = tried.where("fits").select("a", "b").distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        new = written(_verified(_bounded(pairs, points, percent), active, percent), "star")
        links = new if links is None else links.union(new)
        seen = pairs if seen is None else seen.union(pairs)
        looked, found = pairs.count(), new.count()
        if found < least_share * looked or not found:
            return links, seen
        left = written(tried.join(links, ["a", "b"], "left_anti").select("token", "node", "n", "pos"), "unlinked")
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
        open_ = left.select("token").distinct()
        hubs = met.join(open_, "token").join(ends, "node").groupBy("token").agg(best.alias("x")).select("token", *as_hub(F.col("x")))


def near_groups(docs: DataFrame, percent: int = 80, groups: int = 512, block_rows: int = 4096, most_heavy: int = 65_536,
                least_share: float = 0.02) -> DataFrame:
    """row, doc_id, n_shingles, component_id, sha and kept, one row per row of ``docs``.

    Two documents link if 100 times their common shingles reach ``percent`` times all of
    theirs.  Null, empty and blank texts have no shingle and link with nothing; repeated
    rows and copies are in one component; null ids count for no component's smallest id; a
    very long text is one point like any other; an empty table gives no row; other columns are
    ignored.  ``kept`` marks each component's smallest (id, digest of the text ``sha``), null
    ids last, and every row without a shingle.  ``most_heavy`` bounds a list of frequent hash
    slots that decides the order of shingles, not which pairs are found; ``least_share`` says
    when stars give way to the tree; blocks above ``block_rows`` are joined part by part.
    """
    with scratch(docs.sparkSession, "near") as keep:
        return keep(_near_groups(docs, percent, groups, block_rows, most_heavy, least_share), "near-groups")


def _near_groups(docs: DataFrame, percent: int, groups: int, block_rows: int, most_heavy: int, least_share: float) -> DataFrame:
    text = F.encode(text_or_empty(docs), "UTF-8")
    slots = docs.select(text.alias("text")).mapInArrow(_slot_counts, "slot long, n long")
    total = slots.groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(most_heavy)
    heavy = np.array([r.slot for r in total.select("slot").collect()], np.int64)  # most_heavy numbers
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                               text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha")).mapInArrow(
        _profiles(heavy, percent),
        "row long, doc_id long, n long, digest binary, node boolean, prefix array<long>, blob binary, sha binary"), "profiles")
    nodes = rows.where("node")
    tokens = nodes.select(F.col("row").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    # step 1: stars in every block
    repeated = (tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                .where("low < high").select("token"))
    met = written(tokens.join(repeated, "token"), "met")
    active = written(nodes.select(F.col("row").alias("node"), "blob").join(met.select("node").distinct(), "node"), "active")
    points = written(active.mapInArrow(_count_vectors(groups), "node long, n long, fine binary"), "points")
    stars, seen = _star_links(met, points, active, percent, least_share)
    same = Window.partitionBy("digest")  # one row per task that saw the set
    copies = (nodes.select("digest", F.col("row").alias("b")).withColumn("a", F.min("b").over(same)).where("a < b").select("a", "b"))
    links = written(stars.union(copies), "links")
    # step 2: blocks that still hold several components
    component = written(connected_components(links), "components")
    placed = (met.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.min("n").alias("n"),
        F.max("n").alias("m"), F.min(F.col("n") - F.col("pos")).alias("onward"))
    # most blocks have two members, and sizes or places rule most of these out
    two = (100 * F.col("n") >= percent * F.col("m")) & ((100 + percent) * F.col("onward") >= percent * (F.col("n") + F.col("m")))
    mixed = (mixed.where("low < high").where((F.col("members") > 2) | two)
             .select("token", F.ceil(F.col("members") / block_rows).cast("int").alias("salts")))
    placed = written(placed.join(mixed, "token"), "mixed")
    # blocks go to tasks together, as most are small; each member goes out once per part of its block
    together = max(1, -(-(placed.agg(F.sum("salts")).first()[0] or 0) // (2 * block_rows)))
    salted = placed.join(points.select("node", "fine"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other")
    salted = salted.select("token", "node", "component", "n", "pos", "fine", "salt", other).withColumn(
        "i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other"))
    salted = salted.withColumn("task", F.pmod(F.xxhash64("token", "i", "j"), F.lit(together)))
    rest = (salted.groupBy("task").applyInPandas(_block_join(percent), "a long, b long").distinct()
            .join(seen, ["a", "b"], "left_anti"))
    links = links.union(written(_verified(written(rest, "rest"), active, percent), "links"))
    component = connected_components(links)
    # back to all rows, by digest
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")
    sets = rows.where("digest is not null").groupBy("digest").agg(
        F.min(best).alias("best"), F.min(F.when(F.col("node"), F.col("row"))).alias("node"))
    sets = sets.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = sets.groupBy("component").agg(F.min("best").alias("keep"))
    sets = sets.join(least, "component").select("digest", "keep")
    alone = F.col("digest").isNull()
    return rows.select("row", "doc_id", "n", "digest", "sha").join(sets, "digest", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component_id"), "sha",
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("sha") == F.col("keep.sha")))).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: the smallest id, null ids last.

    Rows are told apart by id and text, so where an id stands twice only the text that links
    goes.  Rows that repeat the kept one in both all stay (exact dedup is another operator's
    work), as do rows without a shingle.  An empty table stays empty.
    """
    key = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    groups = near_groups(docs, percent)
    drop = groups.where(~F.col("kept")).select(key(F.col("doc_id"), F.lower(F.hex("sha"))).alias("key")).distinct()
    sha = F.sha2(F.encode(text_or_empty(docs), "UTF-8"), 256)
    keyed = docs.select(F.struct("*").alias("doc"), key(docs["doc_id"].cast("long"), sha).alias("key"))
    return keyed.join(drop, "key", "left_anti").select("doc.*")


def op7_count_vector_rtree(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents")).drop("row", "sha")
