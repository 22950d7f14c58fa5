"""Token counts through a digest cache.

A stored count belongs to a pair of digests: that of the normalised content (null is
empty; nothing else may be normalised, as this vocabulary sees every byte) and that of
the tokenizer's file.  A run looks its documents up, encodes each distinct digest that
is missing once, and appends those counts to the cache.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrgraph.session import scratch_path

from .common import read, text_or_empty, written
from .tokens import encoder, file_digest

CACHE = "content binary, tokenizer string, n_tokens long"


def _packed_once(batches):
    """Each digest of a task once, its text compressed: a group of copies that holds a
    large share of the rows costs one row a task in the exchange."""
    import zstandard

    pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
    for b in batches:
        digests, keep, packed = b.column(0).to_pylist(), [], []
        for i, (d, t) in enumerate(zip(digests, b.column(1))):
            if d not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(d)
                keep.append(i)
                packed.append(pack(t.as_buffer()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary())], ["content", "packed"])


def _counter(path: str):
    def count(batches):
        import zstandard

        unpack, n = zstandard.ZstdDecompressor().decompress, encoder(path, "library").count
        for b in batches:
            texts = (unpack(x.as_py()).decode("utf-8", "replace") for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n(t) for t in texts], pa.int64())],
                                             ["content", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache; empty if nothing was stored at ``cache_path`` so far."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    Null and empty texts have no token; null or repeated ids and repeated rows keep a row
    each; an empty table gives no row; other columns are ignored.  The cache at
    ``cache_path`` (a folder all executors share) gains the counts that were missing.
    """
    spark = docs.sparkSession
    tokenizer = file_digest(tokenizer_path)
    text = F.encode(text_or_empty(docs), "UTF-8")
    rows = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                               F.unhex(F.sha2(text, 256)).alias("content")), "digests")
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer)
    missing = (docs.select(F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text"))
               .mapInArrow(_packed_once, "content binary, packed binary")
               .join(known, "content", "left_anti").dropDuplicates(["content"]))
    new = missing.mapInArrow(_counter(tokenizer_path), "content binary, n_tokens long")
    (new.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path))
    # two runs that share a cache may both have stored a digest
    counts = (read_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer)
              .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return rows.join(counts, "content").select(
        "doc_id", "n_bytes", F.col("n_tokens").cast(T.LongType()), (F.col("n_tokens") > limit).alias("over_limit"))


def op6_digest_cache_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        scratch_path(spark, "token-cache"))
