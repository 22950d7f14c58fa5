"""Exact dedup by Grace hashing.

Tasks first collapse equal contents they see themselves (a table bounded in bytes), so a
text that a third of all rows share leaves each task once or a few times.  What is left
is partitioned by digest bits, and again by one more bit as long as a bucket's distinct
contents exceed the bound; only then are the contents moved, and every bucket goes
through an open-addressing table that compares complete contents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, read, text_or_empty, written


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self):
        self.slots, self.contents, self.hashes, self.bytes = [-1] * 1024, [], [], 0

    def find_or_add(self, content: bytes, hashed: int) -> int:
        """Number of the entry with this content."""
        slots, mask = self.slots, len(self.slots) - 1
        at = hashed & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        entry = slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(hashed)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return entry

    def _grow(self):
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _collapse(table_bytes: int):
    def collapse(batches):
        import zstandard

        # equal contents give equal packed bytes and the other way round
        pack = zstandard.ZstdCompressor(level=1).compress
        table, part = ContentTable(), []
        for b in batches:
            rows, parts, packed = b.column(0).to_pylist(), [], []
            for row, digest, content in zip(rows, b.column(2), b.column(3)):
                content = pack(content.as_buffer())
                entry = table.find_or_add(content, int.from_bytes(digest.as_py()[:8], "little"))
                if entry == len(part):
                    part.append(row)
                    packed.append(content)
                else:
                    packed.append(None)
                parts.append(part[entry])
                if table.bytes > table_bytes:
                    table, part = ContentTable(), []
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array(parts, pa.int64()), pa.array(packed, pa.binary())],
                ["row", "doc_id", "digest", "part", "packed"])

    return collapse


def _classes(bucket: pa.Table) -> pa.Table:
    """Parts of one bucket with the first part of equal content."""
    table, first, cls = ContentTable(), [], []
    for part, digest, content in zip(bucket["part"].to_pylist(), bucket["digest"], bucket["packed"]):
        entry = table.find_or_add(content.as_py(), int.from_bytes(digest.as_py()[:8], "little"))
        if entry == len(first):
            first.append(part)
        cls.append(first[entry])
    return pa.table({"part": bucket["part"].cast(pa.int64()), "cls": pa.array(cls, pa.int64())})


def _bucket_bits(records: DataFrame, bucket_bytes: int) -> int:
    """How often buckets must be halved until each fits: one aggregate on digests a round."""
    contents = records.groupBy("digest").agg(F.max(F.octet_length("packed")).alias("bytes"))
    total = contents.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, int(total // bucket_bytes).bit_length())
    while bits < 62:
        largest = (contents.groupBy(_bucket(bits)).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
                   .where("n > 1").agg(F.max("bytes")).first()[0])
        if (largest or 0) <= bucket_bytes:
            break
        bits += 1
    return bits


def _bucket(bits: int):
    high = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return F.shiftright(high, 60 - bits) if bits < 60 else high


def exact_groups(docs: DataFrame, text_column: str = "text", bucket_bytes: int = 12 << 20) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A to Z; null counts as empty.  The row
    with the largest doc_id stays (a null id is smaller than any; of rows that repeat the
    largest id one stays).  An empty table gives no row; other columns are ignored.
    ``bucket_bytes`` bounds the packed contents of a table.
    """
    content = F.encode(lower_ascii(text_or_empty(docs, text_column)), "UTF-8")
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                        content.alias("content"))
    keyed = keyed.select("row", "doc_id", F.unhex(F.sha2("content", 256)).alias("digest"), "content")
    rows = written(keyed.mapInArrow(_collapse(bucket_bytes), "row long, doc_id long, digest binary, part long, packed binary"),
                   "grace")
    records = rows.where(F.col("packed").isNotNull())
    bucket = _bucket(_bucket_bits(records, bucket_bytes))
    classes = (records.select("part", "digest", "packed", bucket.alias("bucket"))
               .groupBy("bucket").applyInArrow(_classes, "part long, cls long"))
    parts = rows.groupBy("part").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
    whole = Window.partitionBy("cls")  # as many rows as tasks saw the content, not as there are copies
    verdicts = parts.join(classes, "part").select(
        "part", F.max("best").over(whole).alias("best"), F.sum("n").over(whole).alias("group_size"))
    return rows.drop("packed").join(verdicts, "part").select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha = F.sha2(F.encode(lower_ascii(text_or_empty(docs, text_column)), "UTF-8"), 256)
    key = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    stay = exact_groups(docs, text_column).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), key(docs["doc_id"].cast("long"), sha).alias("key"))
    # a repeated row passes the join as often as it stands there; the rows lie by key then and move no more
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def op1_grace_hash_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents")).drop("row")


ORACLE_OP1 = r"""
with t as (select doc_id, lower_ascii, sha256(lower_ascii) as h from (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
  from documents))
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, h as text_sha256
from t window w as (partition by lower_ascii)
"""
