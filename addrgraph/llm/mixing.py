"""Mixing sources to target weights, block by block.

The words of a source, document after document, are cut into blocks of fixed length.  An
output shard has a fixed number of slots; how many of them each source fills is drawn per
shard (the whole part of the expected number for certain, the rest by a multinomial draw
on the fractions).  A source's slots are numbered over all shards; slot i takes the block
that a pseudorandom permutation of the source's block numbers puts at i modulo their
number, with another permutation each time round.  All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.functions.common import let

from .common import WORD, partitions, read, uniform, written


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn.  The target is the
    weight's share of all words, ``cap`` times the source's words at most, the excess shared
    again by weight until none is above.  In order of cap over weight the capped sources come
    first, so the share of one weight unit is the first one that keeps the next source below its cap.
    One row per source in one task.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("unit", (F.sum("source_size").over(every) - F.col("capped")) / F.col("left")))
    unit = F.min(F.when(F.col("unit") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "unit"))).over(every)["unit"]
    return s.withColumn("per", unit).select(
        "source", F.col("source_size").cast("long").alias("source_size"),
        F.least("most", F.coalesce(F.col("per") * F.col("weight"), F.col("most"))).alias("target"))


def permuted(index: Column, size: Column, key: Column, rounds: int = 24) -> Column:
    """Place of ``index`` under a pseudorandom permutation of 0 .. size-1 (swap-or-not:
    each round pairs x with k - x and swaps the pair if a bit of its larger member says so)."""
    def turn(x, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("k")), size) - x, size)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)


def _starts(rows: DataFrame, cell_rows: int) -> DataFrame:
    """``rows`` with ``start``: words of its source before it, in an order of the row's hashes.

    Ranked within cells of the hash's range, then shifted by the cells before, so a source
    that holds a third of all rows is spread over tasks.
    """
    bits = max(0, (rows.count() // cell_rows).bit_length())
    rows = rows.withColumn("cell", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long"))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")
                                     .rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("hash", "check", "row")
                                .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return (placed.join(cells, placed["source"].eqNullSafe(cells["s"]) & (placed["cell"] == cells["c"]))
            .withColumn("start", F.col("base") + F.col("inside")).drop("s", "c", "base", "inside", "cell"))


def block_times(targets: DataFrame, n_shards: int, block_words: int, cap: int, seed: int) -> DataFrame:
    """(source, block, shard, times): which blocks the slots of every shard take."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    s = targets.where("source_size > 0").withColumn("blocks", blocks).withColumn(
        # slots hold whole blocks; a source's last block may be short
        "slots", F.least(F.col("target") / (F.col("source_size") / F.col("blocks")), F.col("blocks") * float(cap)))
    per = s.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn(
        "want", F.col("slots") / n_shards).withColumn("sure", F.floor("want")).withColumn("part", F.col("want") - F.col("sure"))
    shard = Window.partitionBy("shard")
    line = shard.orderBy(F.col("source").asc_nulls_last())
    # always summed in the order of the sources, so that reruns round alike
    all_ = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("high", F.sum("part").over(line)).withColumn("low", F.col("high") - F.col("part"))
           .withColumn("sum", F.sum("part").over(all_)).withColumn("open", F.round("sum").cast("int")))
    # draws with replacement: draw j of a shard falls on the source whose share of the line it hits
    draws = F.when(F.col("open") > 0, F.transform(F.sequence(F.lit(1), F.col("open")), lambda j: uniform(
        F.lit(seed), F.lit("draw"), F.col("shard"), j))).otherwise(F.array().cast("array<double>"))
    hit = F.size(F.filter(draws, lambda u: (u * F.col("sum") >= F.col("low")) & (u * F.col("sum") < F.col("high"))))
    per = per.withColumn("n", F.col("sure") + hit)
    upto = Window.partitionBy("source").orderBy("shard")
    per = (per.withColumn("end", F.least(F.sum("n").over(upto), F.col("blocks") * cap))
           .withColumn("begin", F.coalesce(F.lag("end").over(upto), F.lit(0))).where("end > begin"))
    # slots are made in runs, so that no task holds all slots of a large source
    run = 65_536
    per = per.select("source", "shard", "blocks", "begin", "end",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("begin") - 1) / run))).alias("run"))
    first = F.col("begin") + F.col("run") * run
    last = F.least(F.col("end"), first + run) - 1
    per = per.repartition(partitions(targets.sparkSession), "source", "shard", "run")
    slots = per.select("source", "shard", "blocks", F.explode(F.sequence(first, last)).alias("slot"))
    times_round = F.floor(F.col("slot") / F.col("blocks"))
    block = permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"),
                     F.xxhash64(F.lit(seed), F.col("source"), times_round))
    return slots.select("source", "shard", block.alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, n_shards: int = 8,
        block_words: int = 64, seed: int = 8, cell_rows: int = 8192, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows``: row, doc_id, source, size, source_size, target, start; ``pieces``: row, block,
    from, to (words of the document in the block), times the mix takes it.

    Null and empty texts have size 0 and are never taken; null sources are a source of
    their own, the last; repeated rows and ids are rows like any other; an empty table gives
    none; other columns are ignored; a very long text is many pieces.  The rows and the seed
    decide everything: places in a source go by hashes of id, source and text, so neither the
    input's order nor its partitions matter, and equal rows share what they get in any order
    among themselves.  ``row`` numbers the rows if the caller has to know them; numbers only
    join a row to its pieces.
    """
    slim = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       docs["source"].cast("string").alias("source"), words(docs["text"]).alias("size"),
                       F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string")).alias("hash"),
                       F.xxhash64(F.lit(seed + 1), docs["text"].cast("string"), docs["doc_id"].cast("long")).alias("check"))
    rows = written(slim, "sizes")
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    started = _starts(rows, cell_rows)
    t = targets.withColumnRenamed("source", "s")
    started = written(started.join(t, started["source"].eqNullSafe(t["s"])).drop("s"), "starts")
    cut = F.col("block") * block_words
    pieces = (started.where("size > 0").select(
        "row", "source", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
        .select("row", "source", "block", F.greatest(cut - F.col("start"), F.lit(0)).cast("long").alias("from"),
                F.least(cut + block_words - F.col("start"), F.col("size")).cast("long").alias("to")))
    times = (block_times(targets, n_shards, block_words, cap, seed).groupBy("source", "block")
             .agg(F.count("*").alias("times")).withColumnsRenamed({"source": "s", "block": "b"}))
    # slots come out of few rows, so their size is underrated; both sides grow with the data
    pieces = pieces.join(times.hint("merge"), pieces["source"].eqNullSafe(times["s"]) & (pieces["block"] == times["b"]))
    return started, pieces.select("row", "block", "from", "to", "times")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``.

    A document stands there once for every time round; a time that takes all its words gives
    the text as it is, another the taken words in their order.  ``n_chars``, if there, is counted
    anew.  Documents of which nothing is taken (those without words among them) are not there.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "keyed")
    rows, pieces = mix(keyed.select("row", "doc.doc_id", "doc.source", "doc.text"), row=F.col("row"), **settings)
    taken = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to", "times"))).alias("pieces"))  # of one document
    turns = taken.join(rows.select("row", "size"), "row").join(keyed, "row").withColumn(
        "turn", F.explode(F.sequence(F.lit(1), F.array_max("pieces.times").cast("int"))))
    own = F.filter("pieces", lambda p: p["times"] >= F.col("turn"))
    n = F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])
    every = F.regexp_extract_all(F.col("doc.text").cast("string"), F.lit(WORD), F.lit(0))
    # words of a piece as slices of all words of the document
    part = let(every, lambda ws: F.array_join(F.flatten(F.transform(own, lambda p: F.slice(
        ws, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), " "))
    turns = turns.withColumn("mixed", F.when(n == F.col("size"), F.col("doc.text").cast("string")).otherwise(part))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return turns.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def op8_block_mix(spark, sf_dir):
    rows, pieces = mix(read(spark, sf_dir, "documents"))
    taken = pieces.groupBy("row").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
