"""The trie of conversation prefixes, by collapsing whole sequences.

Identical rebuilt conversations collapse into one weighted sequence with a list of their ids;
sequences that are proper prefixes of others are dropped by an anti-join, which leaves the
leaves of the trie; nodes are aggregates over the prefixes of the weighted sequences.

A node is named by its depth and the sums of the digests of its turns, each bound to its
place.  Sums are running sums, so a conversation of any length is scanned over many ranges
and no task holds one whole; texts are digested where they are read and go no further.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrgraph.plans.prefix import in_ranges, running_scan
from addrgraph.session import scratch

from .common import crc32_sql, read, written

#: 36 bits of a turn's digest each; sums of them fit in a long up to 2 ** 27 turns.
LANES = ["k0", "k1", "k2"]
NODE = ["depth", *LANES]
#: Turns that meet a sequence's attributes together: 2 ** 14.
BLOCK = 14
#: Ids of a piece of an end list.
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _with_attributes(rows: DataFrame, attributes: DataFrame, length: str) -> DataFrame:
    """``rows`` (conv_id, pos, ...) joined with one row per conversation.  The attributes go out
    once per block of turns, so that a conversation of very many turns is split."""
    each = attributes.withColumn("block", F.explode(F.sequence(F.lit(0), F.shiftright(length, BLOCK))))
    return rows.withColumn("block", F.shiftright("pos", BLOCK)).join(each, ["conv_id", "block"]).drop("block")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ...), digest of role and text, chars (code points of the text).

    Turns are in the order of ``turn``, null first; turns that repeat a number in the order of
    their digests, and equal rows are a turn each.  Null role or text is empty."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = written(conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")), "trie-turns")
    placed = running_scan(turns, ["turn", "digest", "row"], {"pos": F.lit(1).cast("long")}, segment="conv_id", stored=True)
    return written(placed.select("conv_id", "pos", "digest", "chars"), "trie-placed")


def rebuilt_turns(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, digest, chars) and the length n of every conversation.

    Conversation c takes the first h = crc32(c as text) % ``heads`` turns of c - c % ``group``
    (fewer or none if it has no more) and then its own turns after its first h."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    lengths = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                         (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).alias("h"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    rest = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = written(lengths.join(bases, "base", "left").select(
        "conv_id", "base", "own", "h", taken.alias("m"), (taken + rest).cast("long").alias("n")), "trie-convs")
    tails = _with_attributes(turns, convs.select("conv_id", "own", "h", "m"), "own").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "chars")
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).select(
        F.col("conv_id").alias("base"), "pos", "digest", "chars")  # a few turns of each base
    copied = convs.select("conv_id", "base", "h").join(first, "base").where("pos <= h").select("conv_id", "pos", "digest", "chars")
    return tails.unionByName(copied), convs.select("conv_id", "n")


def _lanes() -> list[Column]:
    bound = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")), 256)
    return [F.conv(F.substring(bound, 1 + 9 * i, 9), 16, 10).cast("long").alias(k) for i, k in enumerate(LANES)]


def _stream_digests(batches):
    """sha256 of each node's end list; the pieces come sorted by node and first id."""
    node, state, out = None, None, []

    def made():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.string()))], [*NODE, "ends"])

    for b in batches:
        keys = list(zip(*(c.to_pylist() for c in b.columns[:4])))
        for key, text in zip(keys, b.column(4).to_pylist()):
            if key != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if len(out) > 50_000:
            yield made()
            out = []
    if node:
        out.append((*node, state.hexdigest()))
    if out:
        yield made()


def end_digests(ends: DataFrame) -> DataFrame:
    """Digest of each node's ids (depth, lanes, conv_id), ascending and joined by commas.

    Ids are put into order and joined by pieces of PIECE everywhere; a digest is sequential by
    its definition, so a node's pieces then stream through one task, which holds one at a time."""
    placed = in_ranges(ends, [*NODE, "conv_id"], stored=True)
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(*NODE, "conv_id"))
    piece = (placed.withColumn("piece", F.floor(number / PIECE)).groupBy("__bucket", "piece", *NODE)
             .agg(F.sort_array(F.collect_list("conv_id")).alias("ids")))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return (piece.select(*NODE, text.alias("ids"), F.element_at("ids", 1).alias("from")).repartition(*NODE)
            .sortWithinPartitions(*NODE, "from").select(*NODE, "ids")
            .mapInArrow(_stream_digests, "depth long, k0 long, k1 long, k2 long, ends string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations: see COLUMNS.

    Rows without a conv_id belong to no conversation; a conversation that keeps no turn ends
    at the root.  An empty table gives no row, not even a root.  Other columns are ignored."""
    with scratch(conversations.sparkSession, "trie") as keep:
        rows, lengths = rebuilt_turns(numbered_turns(conversations))
        rebuilt = written(rows.select("conv_id", "pos", "chars", *_lanes()), "trie-rebuilt")
        # whole sequences: a long conversation is summed up in part by every task
        sums = rebuilt.groupBy("conv_id").agg(*[F.sum(k).alias(k) for k in LANES])
        ends = written(lengths.join(sums, "conv_id", "left").select(
            "conv_id", F.col("n").alias("depth"), *[F.coalesce(k, F.lit(0)).alias(k) for k in LANES]), "trie-ends")
        sequences = written(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "trie-sequences")
        paths = _with_attributes(rebuilt, sequences.select("conv_id", "weight", F.col("depth").alias("n")), "n")
        step = [F.col(k).alias(f"step_{k}") for k in LANES]
        paths = running_scan(paths.select("conv_id", "pos", "chars", "weight", "n", *step), "pos",
                             {k: F.col(f"step_{k}") for k in LANES}, segment="conv_id")
        paths = written(paths.withColumnRenamed("pos", "depth"), "trie-paths")
        nothing = [F.lit(0).cast("long").alias(k) for k in LANES]
        inner = paths.where("depth < n").select(*NODE).unionByName(
            sequences.where("depth > 0").select(F.lit(0).cast("long").alias("depth"), *nothing)).distinct()
        leaves = sequences.join(inner, NODE, "left_anti").select("conv_id", F.col("depth").alias("n"))
        leaves = written(leaves, "trie-leaves")
        # prefixes of every sequence, the textless one included, with its weight
        starts = sequences.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"),
                                  "weight", F.col("depth").alias("n"), *nothing, *[F.lit(0).cast("long").alias(f"step_{k}") for k in LANES])
        prefixes = paths.unionByName(starts).withColumnRenamed("depth", "pos")
        marks = sequences.select("conv_id", F.col("depth").alias("n")).join(
            leaves.select("conv_id", F.lit(True).alias("leaf")), "conv_id", "left")
        prefixes = _with_attributes(prefixes.drop("n"), marks, "n").withColumnRenamed("pos", "depth")
        prefixes = written(prefixes.withColumn("leaf", F.coalesce("leaf", F.lit(False))), "trie-prefixes")
        nodes = prefixes.groupBy(*NODE).agg(
            F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
            F.count_if("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"),
            *[F.max(f"step_{k}").alias(f"step_{k}") for k in LANES])
        nodes = written(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
        # Each node is counted for one leaf, its smallest; what a leaf counts lies at its end, so a
        # subtree has all that its leaves count but what its own smallest leaf counts above it.
        placed = running_scan(nodes, "depth", {"upto": F.col("value")}, segment="owner", stored=True)
        counted = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("value").alias("counted"))
        counted = _with_attributes(prefixes.where("leaf").select("conv_id", F.col("depth").alias("pos"), *LANES),
                                   leaves.join(counted, "conv_id"), "n")
        same = [F.col(k) for k in NODE]
        ended = end_digests(ends)
        parts = [
            placed.select(*same, "conv_id", "n_convs", "n_leaves", (F.col("value") - F.col("upto")).alias("saved"),
                          *[(F.col(k) - F.col(f"step_{k}")).alias(f"up_{k}") for k in LANES]),
            counted.select(F.col("pos").alias("depth"), *LANES, F.col("counted").alias("saved")),
            nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"),
                                            *[(F.col(k) - F.col(f"step_{k}")).alias(k) for k in LANES], F.lit(1).alias("child")),
            ended.select(*same, "ends"),
        ]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        trie = keep(every.groupBy(*NODE).agg(
            F.max("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_leaves").alias("n_leaves"),
            F.sum("saved").cast("long").alias("saved_tokens"), F.count("child").alias("n_children"), F.max("ends").alias("ends"),
            *[F.max(f"up_{k}").alias(f"up_{k}") for k in LANES]), "trie-result")
    # a parent of very many children: Spark splits its side of the join
    parent = trie.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"up_{k}") for k in LANES],
                         F.col("conv_id").alias("parent_conv_id"))
    return trie.join(parent, ["depth", *[f"up_{k}" for k in LANES]], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_whole_sequence_trie(spark, sf_dir):
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE_OP12 = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 100 as base, {crc} % 6 as h from (select distinct conv_id from conversations where conv_id is not null)
), own as (
  select conv_id, 0 as part, pos, role, text from t join c using (conv_id) where pos > h
  union all
  select c.conv_id, -1, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h
), r as (
  select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, role, text from own
), p as (
  select conv_id, depth, length(text) as chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    over (partition by conv_id order by depth rows unbounded preceding) as seq from r
  union all
  select conv_id, 0, 0, '' from c
), n as (
  select depth, seq, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from p group by depth, seq
), q as (
  select *, coalesce(lag(seq) over (partition by conv_id order by depth), '') as up, max(depth) over (partition by conv_id) as n from p
), kids as (
  select depth - 1 as depth, up as seq, count(distinct seq) as n_children from q where depth > 0 group by depth, up
), ends as (
  select depth, seq, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends from q where depth = n group by depth, seq
), f as (
  select n.*, coalesce(k.n_children, 0) as n_children from n left join kids k on k.depth = n.depth and k.seq = n.seq
), below as (
  select distinct x.depth as top_depth, x.seq as top_seq, y.depth, y.seq
  from q x join q y on y.conv_id = x.conv_id and y.depth >= x.depth
), s as (
  select b.top_depth as depth, b.top_seq as seq, sum((f.n_convs - 1) * f.chars)::bigint as saved_tokens,
    count(*) filter (where f.n_children = 0) as n_leaves
  from below b join f on f.depth = b.depth and f.seq = b.seq group by all
), ups as (select distinct depth, seq, up from q)
select f.conv_id, f.depth, m.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens,
  coalesce(e.ends, sha256('')) as ends_sha256
from f join s on s.depth = f.depth and s.seq = f.seq join ups on ups.depth = f.depth and ups.seq = f.seq
  left join n m on m.depth = f.depth - 1 and m.seq = ups.up
  left join ends e on e.depth = f.depth and e.seq = f.seq
""".replace("{crc}", crc32_sql("cast(conv_id as varchar)"))
