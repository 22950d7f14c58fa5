"""Merkle manifest of a dataset, and proofs by an octopus multiproof.

A row is a leaf, the leaves of a language are a tree, and the trees' roots are the leaves of
one more tree.  Positions come from a segmented scan, so a language that holds a third of all
rows is spread; interior nodes are built in runs of 256 children, eight levels a shuffle.

Proofs are made by partition of leaves.  A partition first computes the coordinates of the
nodes that it cannot derive from its own leaves (the minimal union over all of its proofs),
all are fetched with one join, and the task then derives the interiors that its leaves share
and expands each leaf's proof from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrgraph.plans.prefix import global_rank, running_scan

from .common import crc32_sql, read, written

#: Levels that one shuffle builds: runs of 2 ** 8 children.
STEP = 8
#: Leaves of a partition that proves together: 2 ** 11.
PART = 11
#: The tree over the languages' roots.  A language's tree is named "1" and the language, or "0" for null.
TOP = ""
NODES = "tree string, level int, idx long, node binary"
PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(docs: DataFrame, n_chars: Column | None = None) -> Column:
    """sha256 over the row's fields, each with its length in bytes or ``-`` if null."""
    n_chars = docs["n_chars"] if n_chars is None else n_chars
    fields = [docs["doc_id"], docs["source"], docs["lang"], n_chars, docs["text"]]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def parent(children: Iterable[str]) -> str:
    """Digest of a run of one or two children, all as hex text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def missing_nodes(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The octopus: (level, index) of the nodes that proofs of the ``known`` leaves of a tree of
    ``n`` need and that cannot be derived from those leaves; no node twice."""
    known, level, missing = sorted(set(known)), 0, []
    while n > 1:
        there = set(known)
        missing += [(level, i ^ 1) for i in known if i ^ 1 not in there and i ^ 1 < n]
        known = sorted({i >> 1 for i in known})
        n, level = (n + 1) // 2, level + 1
    return missing


def derive(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """Nodes by level, from the known leaves and the fetched nodes up to the root."""
    levels, known = [], dict(leaves)
    while True:
        level = len(levels)
        nodes = known | {i: node for (at, i), node in fetched.items() if at == level}
        levels.append(nodes)
        if n <= 1:
            return levels
        known = {i >> 1: parent([nodes[i & ~1], nodes[i | 1]] if i | 1 < n else [nodes[i]]) for i in known}
        n = (n + 1) // 2


def path(levels: list[dict[int, str]], at: int, n: int) -> list[tuple[int, str | None]]:
    """(side, sibling) at each level from a leaf to the root; no sibling in a run of one."""
    out = []
    for nodes in levels[:-1]:
        out.append((at & 1, nodes[at ^ 1] if at ^ 1 < n else None))
        at, n = at >> 1, (n + 1) // 2
    return out


def fold(node: str, steps: Iterable[tuple[int, str | None]]) -> str:
    """The root that a node and its siblings give."""
    for side, sibling in steps:
        node = parent([node] if sibling is None else [sibling, node] if side else [node, sibling])
    return node


def _runs(batches):
    """Interior nodes of each run of 2 ** STEP children; rows come sorted by tree and index.
    A first run that is not full is a whole tree, which ends when one node remains; any other
    run is one node of the level STEP higher."""
    def climb(tree, level, start, nodes):
        first, out = start == 0 and len(nodes) < 1 << STEP, []
        for up in range(1, STEP + 1):
            if first and len(nodes) == 1:
                break
            nodes = [parent(nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
            out += [(tree, level + up, (start >> up) + i, bytes.fromhex(x)) for i, x in enumerate(nodes)]
        return out

    def made(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
            ["tree", "level", "idx", "node"])

    run, nodes, rows = None, [], []
    for b in batches:
        for tree, level, idx, node in zip(*(c.to_pylist() for c in b.columns)):
            if run is None or run[0] != tree or run[2] >> STEP != idx >> STEP:
                if run:
                    rows += climb(*run, nodes)
                if len(rows) > 50_000:
                    yield made(rows)
                    rows = []
                run, nodes = (tree, level, idx), []
            nodes.append(node.hex())
    if run:
        rows += climb(*run, nodes)
    if rows:
        yield made(rows)


def build_nodes(leaves: DataFrame, largest: int) -> DataFrame:
    """All nodes (tree, level, idx, node) of the trees whose ``leaves`` have level 0; written.

    Each step goes STEP levels up; ``largest`` is the number of leaves of the largest tree."""
    below, out, step = leaves, leaves, 0
    while 1 << STEP * step < largest:
        top = STEP * (step + 1)
        built = (below.select("tree", "level", "idx", "node").repartition("tree", F.shiftright("idx", STEP))
                 .sortWithinPartitions("tree", "idx").mapInArrow(_runs, NODES))
        built = written(built, f"merkle-{step}")
        out = out.unionByName(built)
        below, step = built.where(F.col("level") == top), step + 1
    return out.select("tree", "level", "idx", "node")


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, root) of every tree."""
    return nodes.where("idx = 0").groupBy("tree").agg(F.max_by("node", "level").alias("root"))


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, idx, doc_id, leaf, tampered), all ``nodes``, the languages' ``trees``
    (tree, n, top: place among the trees, root) and the ``root`` as hex text (None: no row)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def build_manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    Leaves ascend by doc_id, null first; rows that repeat an id ascend by their digest.  Very
    long texts are hashed where they are read and go no further.  ``tampered`` is the digest
    with 1 added to n_chars where 7 divides crc32(doc_id as text), else null."""
    id_text = docs["doc_id"].cast("long").cast("string")
    altered = (F.crc32(F.encode(id_text, "UTF-8")) % 7 == 0) & docs["n_chars"].isNotNull()
    leaves = written(docs.select(
        F.coalesce(F.concat(F.lit("1"), docs["lang"].cast("string")), F.lit("0")).alias("tree"),
        docs["doc_id"].cast("long").alias("doc_id"), leaf_digest(docs).alias("leaf"),
        F.when(altered, leaf_digest(docs, docs["n_chars"].cast("decimal(38,0)") + 1)).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    leaves = written(running_scan(leaves, ["doc_id", "leaf", "row"], {"idx": F.lit(1).cast("long")}, segment="tree", stored=True)
                     .select("tree", (F.col("idx") - 1).alias("idx"), "doc_id", "leaf", "tampered"), "merkle-order")
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    largest, n_trees = sizes.agg(F.max("n"), F.count("*")).first()
    nodes = build_nodes(leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("node")), largest or 0)
    trees = written(global_rank(sizes.join(roots(nodes), "tree"), ["tree"], "top"), "merkle-trees")
    top = build_nodes(trees.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("top").alias("idx"),
                                   F.col("root").alias("node")), n_trees)
    found = roots(top).first()  # one digest
    return Manifest(leaves, nodes.unionByName(top), trees, n_trees, found["root"].hex() if found else None)


def _ask(batches):
    """Coordinates that a partition of leaves lacks, in its own tree and in the one on top."""
    for b in batches:
        out = []
        for tree, part, known, n, top, n_trees in zip(*(c.to_pylist() for c in b.columns)):
            wanted = [(tree, *x) for x in missing_nodes(known, n)] + [(TOP, *x) for x in missing_nodes([top], n_trees)]
            out += [(tree, part, *x) for x in wanted]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))],
                ["tree", "part", "in_tree", "level", "idx"])


def _expand(root: str | None):
    def expand(leaves: pa.Table, told: pa.Table) -> pa.Table:
        tree = leaves["tree"][0].as_py()
        fetched = {tree: {}, TOP: {}}
        for in_tree, level, idx, node, n, top, n_trees in zip(*(told[c].to_pylist() for c in (
                "in_tree", "level", "idx", "node", "n", "top", "n_trees"))):
            if level < 0:
                size, place, trees = n, top, n_trees
            else:
                fetched[in_tree][level, idx] = node.hex()
        at = leaves["idx"].to_pylist()
        leaf = [x.hex() for x in leaves["leaf"].to_pylist()]
        own = derive(dict(zip(at, leaf)), fetched[tree], size)
        subroot = own[-1][0]
        above = derive({place: subroot}, fetched[TOP], trees)
        shared = path(above, place, trees)
        proofs, folded = [], []
        for i, good, bad in zip(at, leaf, leaves["tampered"].to_pylist()):
            steps = path(own, i, size) + shared
            proofs.append(parent(x for _, x in steps if x is not None))
            folded.append(fold(good if bad is None else bad.hex(), steps))
        n = len(at)
        return pa.table({
            "doc_id": leaves["doc_id"].cast(pa.int64()), "leaf": pa.array(leaf, pa.string()),
            "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_())})

    return expand


def prove(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """Proofs of ``leaves`` (rows of the manifest's leaves; default all of them).

    One row per leaf: doc_id, leaf, subroot, root, proof_sha256 (sha256 of the siblings from
    the leaf's level to the root), folded_root (from the tampered leaf where there is one) and
    verified.  No row if there is no leaf."""
    leaves = (manifest.leaves if leaves is None else leaves).withColumn("part", F.shiftright("idx", PART))
    parts = written(leaves.groupBy("tree", "part").agg(F.collect_list("idx").alias("known"))  # at most 2 ** PART
                    .join(manifest.trees.select("tree", "n", "top"), "tree")
                    .withColumn("n_trees", F.lit(manifest.n_trees).cast("long")), "merkle-parts")
    asked = written(parts.select("tree", "part", "known", "n", "top", "n_trees").mapInArrow(
        _ask, "tree string, part long, in_tree string, level int, idx long"), "merkle-asked")
    nodes = manifest.nodes.select(F.col("tree").alias("in_tree"), "level", "idx", "node")
    told = asked.join(nodes, ["in_tree", "level", "idx"])
    about = parts.select("tree", "part", F.lit(-1).alias("level"), "n", "top", "n_trees")
    told = told.unionByName(about, allowMissingColumns=True)
    return leaves.groupBy("tree", "part").cogroup(told.groupBy("tree", "part")).applyInArrow(_expand(manifest.root), PROOFS)


def op11_octopus_manifest(spark, sf_dir):
    return prove(build_manifest(read(spark, sf_dir, "documents")))


ORACLE_OP11 = r"""
with recursive d as (
  select doc_id, lang,
    concat(coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-')) as head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') as tail
  from documents
), leaves as (
  select doc_id, lang, sha256(concat(head, coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-'), tail)) as leaf,
    sha256(concat(head, coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-'), tail)) as changed
  from d
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by lang) as n from leaves
), up as (
  select lang, 0 as lv, pos as idx, n, leaf as node from placed
  union all
  select lang, lv + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' order by idx))
  from up where n > 1 group by lang, lv, idx // 2, n
), subroots as (
  select lang, node as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as trees
  from up where n = 1
), top as (
  select 0 as lv, place as idx, trees as n, subroot as node from subroots
  union all
  select lv + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' order by idx)) from top where n > 1 group by lv, idx // 2, n
), kin as (
  select p.doc_id, p.leaf, u.lv, (p.pos >> u.lv) & 1 as side, u.node
  from placed p join up u on u.lang is not distinct from p.lang and u.n > 1 and u.idx = xor(p.pos >> u.lv, 1)
  union all
  select p.doc_id, p.leaf, 1000 + t.lv, (s.place >> t.lv) & 1, t.node
  from placed p join subroots s on s.lang is not distinct from p.lang join top t on t.n > 1 and t.idx = xor(s.place >> t.lv, 1)
), proofs as (
  select doc_id, leaf, sha256(string_agg(node, '' order by lv)) as proof from kin group by all
), sizes as (select distinct lang, lv from up where n > 1), tops as (select distinct lv from top where n > 1),
steps as (
  select p.doc_id, p.leaf, z.lv from placed p join sizes z on z.lang is not distinct from p.lang
  union all select p.doc_id, p.leaf, 1000 + t.lv from placed p cross join tops t
), numbered as (
  select s.doc_id, s.leaf, k.side, k.node, row_number() over (partition by s.doc_id, s.leaf order by s.lv) as step
  from steps s left join kin k on k.doc_id = s.doc_id and k.leaf = s.leaf and k.lv = s.lv
), folded as (
  select doc_id, leaf, 0 as step,
    case when {crc} % 7 = 0 and changed is not null then changed else leaf end as node from placed
  union all
  select f.doc_id, f.leaf, f.step + 1,
    sha256(case when m.node is null then f.node when m.side = 1 then m.node || f.node else f.node || m.node end)
  from folded f join numbered m on m.doc_id = f.doc_id and m.leaf = f.leaf and m.step = f.step + 1
)
select p.doc_id, p.leaf, s.subroot, t.node as root, coalesce(x.proof, sha256('')) as proof_sha256, f.node as folded_root,
  f.node = t.node as verified
from placed p join subroots s on s.lang is not distinct from p.lang join top t on t.n = 1
  left join proofs x on x.doc_id = p.doc_id and x.leaf = p.leaf
  join (select doc_id, leaf, arg_max(node, step) as node from folded group by all) f on f.doc_id = p.doc_id and f.leaf = p.leaf
""".replace("{crc}", crc32_sql("cast(doc_id as varchar)"))
