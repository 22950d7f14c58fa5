"""Best-fit packing of token sequences with certified bin counts.

Pieces are dealt to partitions of bounded size and packed by best-fit decreasing.  Dual
feasible functions bound each partition's bin count, and that of all pieces together, from
below; where a bound is met the packing is certified optimal.  Partitions with a gap to their
own bound give up the pieces of their bins that are not full, exchange them and pack again
until no bin is saved; certified ones keep theirs.  Partitions that are each optimal need not
be so together: while the common bound is not met, the bins that are not full of all of them
are exchanged in the same way.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_returned, read, text_batches, text_or_empty, written
from .tokens import encoder

PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, bins long, bound long, full boolean"


REMEMBERED = 200_000  # word pieces a worker keeps the ids of


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        memory_returned()
        ids_of = encoder(path, "ranks", REMEMBERED).ids
        for b in batches:
            out = []
            for row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = ids_of(text) + end
                n, start = len(ids) // 4, 0
                length = (n - 1) % capacity + 1  # the first piece takes what is left over
                for piece in range((n + capacity - 1) // capacity):
                    out.append((row, doc_id, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                    start, length = start + length, capacity
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def bin_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Fewest bins any packing of ``lengths`` (each so many times) can have, as far as two families of dual
    feasible functions show: dropping pieces below a size while rounding their complements
    up, and rounding to multiples of capacity over k."""
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, 1 if times is None else times)
    size = np.arange(capacity + 1)
    upto_n, upto_s = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(upto_s[-1]) // capacity)
    for low in range(1, capacity // 2 + 1):
        high = capacity - low  # larger pieces count whole, smaller than ``low`` not at all
        total = int(upto_n[-1] - upto_n[high]) * capacity + int(upto_s[high] - upto_s[low - 1])
        best = max(best, -(-total // capacity))
    for k in range(1, 64):  # in units of capacity / k, times k + 1
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, (scaled // capacity) * capacity)  # times capacity over k * capacity
        total = int((count * value).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and the fill of every bin.

    Open bins stand in stacks by what is free in them; one bit a stack tells which are not
    empty, so the best fit is the lowest bit from the piece's length up.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    stacks, some = [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                some ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if free > n:
            stacks[free - n].append(b)
            some |= 1 << (free - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack(capacity: int, base: int):
    def pack(key, rows):
        rows = rows.sort_values(["length", "row", "piece"], kind="stable").drop(columns="part")
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return rows.assign(sequence_id=base + (int(key[0]) << 24) + bins, offset=offsets, bins=len(fill),
                           bound=bin_bound(lengths, capacity), full=(fill == capacity)[bins])

    return pack


def _packed(pieces: DataFrame, capacity: int, part_pieces: int, turn: int) -> DataFrame:
    parts = max(1, -(-pieces.count() // part_pieces))
    part = F.pmod(F.xxhash64(F.lit(turn), "row", "piece"), F.lit(parts))
    return written(pieces.select(*[c.split()[0] for c in PIECE.split(", ")], part.alias("part")).groupBy("part")
                   .applyInPandas(_pack(capacity, turn << 50), PACKED), "packed")


def _bins(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, part_pieces: int = 65_536) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the
    bins and bound of the partition that packed it.

    Null and empty texts are the end id alone; null and repeated ids and repeated rows are
    documents of their own; an empty table gives no row; other columns are ignored.  A
    document of more than ``capacity`` tokens is cut, its first piece taking what is left over,
    so a very long text is many whole sequences and one piece.  Pieces of equal length are
    packed in the order of their rows.
    """
    with text_batches(docs.sparkSession):
        pieces = written(docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                                     text_or_empty(docs).alias("text"))
                         .mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECE), "pieces")
    # a piece as long as a sequence is one, in any packing
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"),
        F.lit(True).alias("full"))
    part = pieces.where(F.col("length") < capacity)
    packed, done = _packed(part, capacity, part_pieces, 1), []
    lengths = part.groupBy("length").count().collect()  # as many rows as lengths below the capacity
    bound = bin_bound(np.array([r["length"] for r in lengths], np.int64), capacity,
                      np.array([r["count"] for r in lengths], np.int64)) if lengths else 0
    bins = _bins(packed)
    certified = F.col("bins") <= F.col("bound")
    together = False
    for turn in count(2):
        if bins <= bound:
            break  # certified: no packing takes fewer
        loose = packed.where(~F.col("full")) if together else packed.where(~F.col("full") & ~certified)
        again = _packed(loose, capacity, part_pieces, turn)
        saved = _bins(loose) - _bins(again)
        if saved <= 0:
            if together:
                break
            together = True
            continue
        done.append(packed.where("full"))
        packed = again if together else again.unionByName(packed.where(~F.col("full") & certified))
        bins -= saved
    for d in (*done, whole):
        packed = packed.unionByName(d)
    return packed.drop("row", "full")


def op5_bound_certified_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
