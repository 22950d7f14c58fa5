"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one point with a count.  In every tree a node is split at the median of
a random projection, points nearer to it than linked points are usually apart go to both
sides, and nodes of at most ``leaf`` points are compared pair by pair in double precision.
Nodes too large for one task are split by Spark, level by level; from ``task_points`` points
down a task grows the rest of the tree.  A node of any size whose points are so close
together that no split separates them is compared whole, block by block: its links are
counted by point and connected by stars, so its output is linear in its points.  Links found
by any tree are united; every link is verified, so only recall is approximate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, read, written

NODE = ["tree", "label", "dim", "path"]


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    x = F.transform(v, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def _direction(seed: int, tree: int, path: str, dim: int) -> np.ndarray:
    key = [seed, int(tree), *path.encode()]
    direction = np.random.default_rng(key).standard_normal(dim)
    return direction / np.sqrt(direction @ direction)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _project(seed: int):
    def project(batches):
        for b in batches:
            out = np.empty(len(b))
            for (tree, dim, path), rows in b.groupby(["tree", "dim", "path"]).indices.items():
                out[rows] = _unit(b["vec"].iloc[rows]) @ _direction(seed, tree, path, dim)
            yield b.assign(at=out)

    return project


def _members(groups: pd.Series, below: int | None = None) -> np.ndarray:
    """One column for each of the groups (smaller than ``below``): the points in it."""
    own = [[] if g is None else [k for k in g if below is None or k < below] for g in groups]
    number = {k: i for i, k in enumerate(sorted({k for g in own for k in g}))}
    out = np.zeros((len(own), len(number)), np.float32)
    for row, g in enumerate(own):
        out[row, [number[k] for k in g]] = 1
    return out


def _linked(x: np.ndarray, ids: np.ndarray, member: np.ndarray, cosine: float, block: int = 1024):
    """Pairs of unit rows at or above the cosine and in no common group, in blocks."""
    for i in range(0, len(x), block):
        for j in range(i, len(x), block):
            hit = x[i:i + block] @ x[j:j + block].T >= cosine
            if member.shape[1]:
                hit &= member[i:i + block] @ member[j:j + block].T == 0
            a, b = np.nonzero(hit)
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield np.minimum(ids[i + a], ids[j + b]), np.maximum(ids[i + a], ids[j + b])


def _ends(x: np.ndarray, tree: int, path: str, cosine: float, leaf: int, dense: float, seed: int, member: np.ndarray):
    """Ends of a tree below ``path``: points, path, and whether they are more than a leaf and so
    close together that no split separates them.  Points of one group end nowhere."""
    # linked points lie this far apart at most; projected, a standard deviation of it
    margin = np.sqrt((2 - 2 * cosine) / x.shape[1])
    stack = [(np.arange(len(x)), path)]
    while stack:
        at, path = stack.pop()
        if member[at].all(0).any():
            continue  # together in a node that is compared whole
        if len(at) > leaf:
            p = x[at] @ _direction(seed, tree, path, x.shape[1])
            middle = np.median(p)
            left, right = at[p <= middle + margin], at[p >= middle - margin]
            if max(len(left), len(right)) < dense * len(at):
                stack += [(left, path + "l"), (right, path + "r")]
                continue
        yield at, path, len(at) > leaf


def _close(cosine: float, leaf: int, dense: float, seed: int):
    def close(key, rows):
        """Points and paths of the ends that no split separates."""
        x, ids = _unit(rows["vec"]), rows["row"].to_numpy()
        found = [(ids[at], path) for at, path, whole in _ends(x, key[0], key[3], cosine, leaf, dense, seed, np.empty((len(x), 0), bool)) if whole]
        paths = [p for a, p in found for _ in a]
        return pd.DataFrame({"row": np.concatenate([np.empty(0, np.int64), *(a for a, _ in found)]),
                             "tree": np.full(len(paths), key[0], np.int32), "label": pd.Series([key[1]] * len(paths), dtype=object),
                             "dim": np.full(len(paths), key[2], np.int32), "path": pd.Series(paths, dtype=object)})

    return close


def _grow(cosine: float, leaf: int, dense: float, seed: int):
    def grow(key, rows):
        x, member = _unit(rows["vec"]), _members(rows["groups"])
        ids, found = rows["row"].to_numpy(), []
        for at, _, _ in _ends(x, key[0], key[3], cosine, leaf, dense, seed, member):
            found.extend(_linked(x[at], ids[at], member[at], cosine))
        if not found:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]),
                             "b": np.concatenate([f[1] for f in found])}).drop_duplicates()

    return grow


def _stars(hit: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Links that connect what the matrix connects: in every component all to its first point."""
    back = np.ascontiguousarray(hit.T)
    new_left, new_right = hit.any(1), hit.any(0)
    for first in np.flatnonzero(new_left):
        if not new_left[first]:
            continue
        step = np.array([first])
        new_left[first] = False
        while len(step):
            other = np.flatnonzero(hit[step].any(0) & new_right)
            new_right[other] = False
            step = np.flatnonzero(back[other].any(0) & new_left)
            new_left[step] = False
            ends = np.concatenate([right[other], left[step]])
            ends = ends[ends != left[first]]
            yield np.full(len(ends), left[first]), ends


def _compare_block(cosine: float, rows_a_time: int = 1024):
    """Of two parts of a node compared whole: links that connect the same points, and for each point (as
    a link to itself) how many vectors it links with that no smaller node compared whole has with it."""
    def compare(key, rows):
        group, i, j = key
        x, member = _unit(rows["vec"]), _members(rows["groups"], below=group)
        ids, salts, copies = (rows[c].to_numpy() for c in ("row", "salt", "copies"))
        left, right = np.flatnonzero(salts == i), np.flatnonzero(salts == j)
        hit = np.zeros((len(left), len(right)), bool)
        others, weight = np.zeros(len(rows)), copies.astype(float)
        for at in range(0, len(left), rows_a_time):
            own = left[at:at + rows_a_time]
            fits = x[own] @ x[right].T >= cosine
            if i == j:
                fits[np.arange(len(own)), at + np.arange(len(own))] = False
            hit[at:at + rows_a_time] = fits
            if member.shape[1]:
                fits &= member[own] @ member[right].T == 0
            fits = fits.astype(float)
            others[own] += fits @ weight[right]
            if i != j:
                others[right] += weight[own] @ fits
        some = np.flatnonzero(others)
        found = [(ids[some], ids[some], others[some].astype(np.int64))]
        found += [(a, b, np.zeros(len(a), np.int64)) for a, b in _stars(hit, ids[left], ids[right])]
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("a", "b", "others"))})

    return compare


def _compared_whole(nodes: DataFrame, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """What _compare_block tells of all parts of ``nodes``, and the groups (numbers of such nodes) of their points."""
    groups = written(nodes.groupBy(*NODE).agg(F.count("*").alias("size"))
                     .withColumn("group", F.monotonically_increasing_id()), "groups")
    nodes = written(nodes.join(groups, NODE).select("row", "vec", "copies", "group", "size"), "whole")
    groups = nodes.groupBy("row").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    salts = F.ceil(F.col("size") / block).cast("int")
    other = F.explode(F.sequence(F.lit(0), salts - 1)).alias("other")
    parts = (nodes.join(groups, "row").withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
             .select("row", "vec", "copies", "groups", "group", "salt", other)
             .withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other")))
    return written(parts.groupBy("group", "i", "j").applyInPandas(_compare_block(cosine), "a long, b long, others long"),
                   "compared"), groups


def forest_links(points: DataFrame, cosine: float, trees: int, leaf: int, dense: float, task_points: int,
                 seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``points`` (row, label, vec, copies): distinct links (a, b); of the nodes compared whole the
    links (a, b) that connect the same points, and (a, others), how many vectors a links with there.
    A link is among the first or counted by the last, never both."""
    nodes = points.select("row", "label", F.size("vec").alias("dim"), "vec", "copies",
                          F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit("").alias("path"))
    ready = whole = None
    while True:
        sizes = nodes.groupBy(*NODE).agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > task_points).drop("n")
        if large.isEmpty():
            ready = nodes if ready is None else ready.unionByName(nodes)
            break
        done = nodes.join(large, NODE, "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        split = nodes.join(large, NODE)
        split = written(split.mapInPandas(_project(seed), T.StructType([*split.schema, T.StructField("at", T.DoubleType())])),
                        "projected")
        cuts = split.groupBy(*NODE).agg(F.percentile_approx("at", 0.5, 1000).alias("middle"))
        # as in _grow: points nearer to the cut than linked points are usually apart go to both sides
        margin = F.sqrt(F.lit(2 - 2 * cosine) / F.col("dim"))
        split = split.join(cuts, NODE).select(*nodes.columns, (F.col("at") <= F.col("middle") + margin).alias("left"),
                                              (F.col("at") >= F.col("middle") - margin).alias("right"))
        sides = split.groupBy(*NODE).agg(F.count("*").alias("n"), F.count_if("left").alias("l"), F.count_if("right").alias("r"))
        # the split leaves as many pairs to compare as there are
        close = written(sides.where("l * l + r * r >= n * n").select(*NODE), "close")
        # a whole tree compared once: the other trees of the label have the same points
        roots = close.where("path = ''").groupBy("label", "dim").agg(F.min("tree").alias("first"))
        split = split.join(roots, ["label", "dim"], "left").where("first is null or first = tree").drop("first")
        own = split.join(close, NODE, "left_semi").select(*nodes.columns)
        whole = own if whole is None else whole.unionByName(own)
        paths = F.array(F.when(F.col("left"), F.concat("path", F.lit("l"))), F.when(F.col("right"), F.concat("path", F.lit("r"))))
        nodes = written(split.join(close, NODE, "left_anti")
                        .withColumn("path", F.explode(F.filter(paths, lambda s: s.isNotNull())))
                        .select(*nodes.columns), "nodes")
    # nodes that one task holds: first those whose points no split separates
    close = written(ready.groupBy(*NODE).applyInPandas(_close(cosine, leaf, dense, seed),
                                                       "row long, tree int, label string, dim int, path string"), "close")
    if not close.isEmpty():
        roots = close.where("path = ''").groupBy("label", "dim").agg(F.min("tree").alias("first"))
        own = close.join(roots, ["label", "dim"], "left").where("first is null or (first = tree and path = '')").drop("first")
        own = own.join(points.select("row", "vec", "copies"), "row").select(*nodes.columns)
        whole = own if whole is None else whole.unionByName(own)
        ready = ready.join(roots, ["label", "dim"], "left_anti").select(*nodes.columns)
    none = points.sparkSession.createDataFrame([], "a long, b long, others long")
    if whole is None:
        compared, ready = none, ready.withColumn("groups", F.lit(None).cast("array<long>"))
    else:
        compared, groups = _compared_whole(whole, cosine, max(1, task_points // 2))
        ready = ready.join(groups, "row", "left")
    links = ready.groupBy(*NODE).applyInPandas(_grow(cosine, leaf, dense, seed), "a long, b long").distinct()
    return (links, compared.where("a <> b").select("a", "b"), compared.where("a = b").select("a", "others"))


def vector_groups(vectors: DataFrame, cosine: float = 0.93, trees: int = 6, leaf: int = 256, dense: float = 0.9,
                  task_points: int = 8192, seed: int = 10) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Vectors are compared if their labels and lengths are equal and not null.  Unusable vectors and null
    labels link with nothing.  Null ids are smaller than none: a component's id is its smallest
    id that is not null.  Repeated rows are vectors of their own, linked as equal ones are; an
    empty table gives no row; other columns are ignored; ties at the cosine are links.
    """
    v = vectors["embedding"]
    plain = F.array_join(F.transform(v, lambda c: (c + F.lit(0).cast("float")).cast("string")), ",")
    ok = usable(v) & vectors["label"].isNotNull()
    rows = written(vectors.select(
        F.monotonically_increasing_id().alias("row"), vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["label"].cast("string").alias("label"), F.when(ok, v).alias("vec"),
        F.when(ok, F.unhex(F.sha2(F.concat_ws("|", vectors["label"].cast("string"), plain), 256))).alias("same")), "vectors")
    copies = written(rows.where("same is not null").groupBy("same").agg(
        F.min("row").alias("row"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "copies")
    points = rows.join(copies.select("row", "copies"), "row").select("row", "label", "vec", "copies")
    links, connecting, counted = forest_links(points, cosine, trees, leaf, dense, task_points, seed)
    links = written(links, "links")
    both = links.union(links.select("b", "a"))
    others = (both.join(copies.select(F.col("row").alias("b"), "copies"), "b").select("a", "copies").union(counted)
              .groupBy("a").agg(F.sum("copies").alias("others")))
    components = connected_components(links.union(connecting))
    point = (copies.join(others, copies["row"] == others["a"], "left").drop("a")
             .join(components, copies["row"] == components["node"], "left").drop("node")
             .withColumn("component", F.coalesce("component", "row")))
    first = point.groupBy("component").agg(F.min("first_id").alias("component_id"))
    point = point.join(first, "component").select(
        "same", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "same").join(point, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_projection_forest(spark, sf_dir):
    return vector_groups(read(spark, sf_dir, "embeddings"))
