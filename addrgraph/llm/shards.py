"""Uniform shuffle into shards of exact size (hypergeometric communication matrix).

A block is up to ``2**block_bits`` rows that stand together in the input.  For every
block the exact number of its rows that goes to every shard is drawn from the
multivariate hypergeometric law, so that a row permutation of all the data is
simulated: permute within the block, exchange by those counts, permute again within
the shard.  All steps are DataFrame expressions.

The counts are drawn down a binary tree over the blocks: the root holds the shard
sizes, each node splits its counts between its halves, and all nodes of a level are
drawn at once, so the number of steps is the logarithm of the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.functions.common import let

from .common import text_or_empty, uniform, written


def hypergeometric(u: Column, total: Column, marked: Column, draws: Column, reach: float = 12.0) -> Column:
    """Number of marked among ``draws`` drawn without return from ``total``, at quantile ``u``.

    The weights are built outwards from the mode by their ratios, within ``reach``
    standard deviations (beyond them a double holds nothing), and summed to ``u``.
    """
    n, k, d = (c.cast("double") for c in (total, marked, draws))
    lo = F.greatest(F.lit(0.0), d + k - n)
    hi = F.least(d, k)
    mode = F.least(hi, F.greatest(lo, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    sd = F.sqrt(F.greatest(F.lit(0.0), d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))))
    width = F.ceil(reach * sd + 8).cast("double")
    no = F.array().cast("array<double>")
    state = "struct<w:double,s:double,n:double>"

    def rise(x):  # weight of x over weight of x - 1
        return (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))

    def ratios(m):  # upwards and downwards from the mode
        up, down = F.least(hi, m + width) - m, m - F.greatest(lo, m - width)
        return F.struct(
            m.alias("mode"),
            F.when(up > 0, F.transform(F.sequence(F.lit(1), up.cast("int")), lambda i: rise(m + i))).otherwise(no).alias("up"),
            F.when(down > 0, F.transform(F.sequence(F.lit(1), down.cast("int")), lambda i: 1 / rise(m - i + 1)))
            .otherwise(no).alias("down"))

    def run(xs, want):  # mass of all, and how many are needed to reach ``want``
        return F.aggregate(
            xs, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("n")).cast(state),
            lambda a, r: F.struct((a.w * r).alias("w"), (a.s + a.w * r).alias("s"),
                                  (a.n + F.when(a.s < want, 1.0).otherwise(0.0)).alias("n")).cast(state))

    def pick(r):
        def at(mass):
            goal = u * (1 + mass.above + mass.below)
            return (F.when(goal < 1, r.mode)
                    .when(goal < 1 + mass.above, r.mode + run(r.up, goal - 1).n)
                    .otherwise(r.mode - run(r.down, goal - 1 - mass.above).n))

        return let(F.struct(run(r.up, F.lit(0.0)).s.alias("above"), run(r.down, F.lit(0.0)).s.alias("below")), at)

    drawn = let(mode, lambda m: let(ratios(m), pick))
    return F.when((n <= 0) | (k <= 0) | (d <= 0), F.lit(0)).when(d >= n, marked).when(
        k >= n, draws).otherwise(drawn).cast("long")


def communication_matrix(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Rows (block, counts): how many of a block's ``rows`` go to each shard.

    Row sums are the block sizes, column sums differ by one at most.
    """
    spark = blocks.sparkSession
    # one row per block of thousands of rows
    leaves = written(blocks.select("block", "rows").withColumn(
        "leaf", F.row_number().over(Window.orderBy("block")) - 1), "blocks")
    total, n = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    depth = max(0, (n - 1).bit_length())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    # the shards that get one row more are a draw too
    extra = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(
        uniform(F.lit(seed), F.lit("size"), s).alias("u"), s.alias("s"))))
    order = [r.s for r in spark.range(1).select(extra.alias("x")).first().x]
    sizes = [sizes[order.index(s)] for s in range(n_shards)]
    nodes = spark.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(x).cast("long") for x in sizes]).alias("counts"))
    for level in range(depth):
        half = depth - level - 1
        left = (leaves.groupBy(F.shiftright("leaf", half).cast("long").alias("half")).agg(F.sum("rows").alias("m"))
                .where("half % 2 = 0").select((F.col("half") / 2).cast("long").alias("node"), "m"))
        at, tier = nodes.join(left, "node"), F.lit(level)

        def share(acc, x):
            got = hypergeometric(
                uniform(F.lit(seed), tier, F.col("node"), F.size(acc.got)),
                acc.n, x, acc.d)
            return F.struct((acc.n - x).alias("n"), (acc.d - got).alias("d"), F.concat(acc.got, F.array(got)).alias("got"))

        start = F.struct(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
                         F.col("m").cast("long").alias("d"), F.array().cast("array<long>").alias("got"))
        at = at.withColumn("got", F.aggregate("counts", start, share, lambda a: a.got))
        rest = F.zip_with("counts", "got", lambda x, y: x - y)
        nodes = written(at.select(F.inline(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("counts"))))), "nodes")
    return leaves.join(nodes, leaves.leaf == nodes.node).select("block", "counts")


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 20, block_bits: int = 16,
                        cell_rows: int = 50_000) -> DataFrame:
    """Columns of ``docs`` that the result names (doc_id, size, text_crc32), shard and slot.

    Every row lands in exactly one shard; shard counts differ by one at most; slots are
    0, 1, ... in every shard.  Null texts count as empty.  Repeated rows and null ids are
    rows like any other; an empty table gives an empty result; other columns are ignored.
    Very long texts are only measured.  Rows are numbered by partition, so the seed decides
    everything for one order of the rows and one way of splitting them, not for others.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.encode(text_or_empty(docs), "UTF-8")
    slim = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    rows = written(slim.withColumn("block", F.shiftright("_row", block_bits)), "rows")
    blocks = rows.groupBy("block").agg(F.count("*").alias("rows"))
    matrix = communication_matrix(blocks, n_shards, seed)
    # permute within the block, then deal out by the block's counts
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "_row"), "_row")
    placed = rows.withColumn("_at", F.row_number().over(local)).join(matrix, "block")
    shard = F.aggregate("counts", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
                        lambda a, x: F.struct((a["sum"] + x).alias("sum"),
                                              (a["shard"] + F.when(a["sum"] + x < F.col("_at"), 1).otherwise(0)).alias("shard")),
                        lambda a: a["shard"])
    placed = written(placed.select("doc_id", "size", "text_crc32", "_row", shard.alias("shard"))
                     .withColumn("_key", F.xxhash64(F.lit(seed), F.lit("shard"), "_row")), "placed")
    # permute again within the shard: the key's range is cut into cells, so no task sorts a whole shard
    per_shard = placed.count() // n_shards + 1
    bits = max(0, (per_shard // cell_rows).bit_length())
    cell = F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long")
    placed = placed.withColumn("_cell", cell)
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = Window.partitionBy("shard", "_cell").orderBy("_key", "_row")
    return (placed.withColumn("_in", F.row_number().over(within) - 1).join(offsets, ["shard", "_cell"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("_before") + F.col("_in")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def op4_hypergeometric_shards(spark, sf_dir):
    from .common import read
    return shuffle_into_shards(read(spark, sf_dir, "documents"))
