"""Trees as (tree_id, node, parent, w, level) rows (root: parent null), and integration over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .paths import all_pairs, bfs_tree
from .stage import cut

#: Levels that one plan passes before its lineage is cut.
EVERY = 3

TREE = "tree_id long, node long, parent long, w double, level long"


def from_bfs(edges: DataFrame, root: int, tree_id: int = 0) -> DataFrame:
    """The BFS tree with the weights of its edges."""
    t = bfs_tree(edges, root)
    w = edges.select(F.col("src").alias("parent"), F.col("dst").alias("v"), "w")
    return t.join(w, ["parent", "v"], "left").select(F.lit(tree_id).cast("long").alias("tree_id"), F.col("v").alias("node"), "parent", "w", "level")


def rooted(tree_edges: DataFrame, root: int, tree_id: int = 0) -> DataFrame:
    return from_bfs(tree_edges, root, tree_id)


def minimum_spanning(edges: DataFrame) -> DataFrame:
    """(src, dst, w), src < dst: the minimum spanning forest by Boruvka's rounds; ties by (w, src, dst), so it is the one that Kruskal's order gives.

    Each round every component takes its cheapest outgoing edge (a minimum per component) and
    merges along it; the number of components at least halves.
    """
    from .paths import components

    half = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
    vertices = half.select(F.col("src").alias("v")).unionByName(half.select(F.col("dst").alias("v"))).distinct()
    label = cut(vertices.select("v", F.col("v").alias("c")))
    tree = None
    while True:
        end = lambda x, c: label.select(F.col("v").alias(x), F.col("c").alias(c))
        out = half.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("a <> b")
        both = out.select("a", F.struct("w", "src", "dst").alias("e")).unionByName(out.select(F.col("b").alias("a"), F.struct("w", "src", "dst").alias("e")))
        picked = cut(both.groupBy("a").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.w").distinct())
        if picked.isEmpty():
            return tree if tree is not None else half.limit(0)
        tree = picked if tree is None else cut(tree.unionByName(picked).distinct())
        links = tree.select("src", "dst").unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        label = cut(components(vertices, links).withColumnRenamed("component", "c"))


def integrate(tree: DataFrame, field: DataFrame, rate: float) -> DataFrame:
    """(tree_id, v, k, x): sum over w of exp(rate * dist_T(v, w)) F(w), exactly, by one join up and one down for each level; all trees advance together.

    Only exponential kernels factor along a path, so only a rate is taken. Nodes without a field
    value (Steiner nodes) count as zero and are returned too.
    """
    f = F.exp(F.lit(float(rate)) * F.col("w"))
    ks = field.select("k").distinct()
    base = tree.crossJoin(ks).join(field.withColumnRenamed("v", "node"), ["node", "k"], "left")  # one row for each node and field column
    base = cut(base.select("tree_id", "node", "parent", "w", "level", "k", F.coalesce("x", F.lit(0.0)).alias("p")))
    depth = base.agg(F.max("level")).first()[0] or 0
    up = {depth: base.where(F.col("level") == depth)}
    for level in range(depth - 1, -1, -1):  # only two levels meet in a join
        add = up[level + 1].groupBy("tree_id", F.col("parent").alias("node"), "k").agg(F.sum(f * F.col("p")).alias("add"))
        row = base.where(F.col("level") == level).join(add, ["tree_id", "node", "k"], "left").withColumn("p", F.col("p") + F.coalesce("add", F.lit(0.0))).drop("add")
        up[level] = cut(row) if (depth - level) % EVERY == 0 else row
    done = up[0].select("tree_id", "node", "k", F.col("p").alias("s"))
    out = done
    for level in range(1, depth + 1):
        above = done.withColumnRenamed("node", "parent")
        done = up[level].join(above, ["tree_id", "parent", "k"]).select("tree_id", "node", "k", (f * F.col("s") + (1 - f * f) * F.col("p")).alias("s"))
        done = cut(done) if level % EVERY == 0 else done
        out = out.unionByName(done)
    return out.select("tree_id", F.col("node").alias("v"), "k", F.col("s").alias("x"))


def mean_over_trees(results: DataFrame) -> DataFrame:
    return results.groupBy("v", "k").agg(F.avg("x").alias("x"))


def least_over_trees(results: DataFrame) -> DataFrame:
    return results.groupBy("v", "k").agg(F.min("x").alias("x"))


def shortest_path_ball(edges: DataFrame, distances: DataFrame, center: int, radius: float, allowed: DataFrame | None = None) -> DataFrame:
    """(v): what can be reached from ``center`` over ``allowed`` (v) vertices that are all nearer to it than ``radius``. ``distances`` is (i, j, x)."""
    near = distances.where((F.col("i") == center) & (F.col("x") < radius)).select(F.col("j").alias("v"))
    near = near if allowed is None else near.join(allowed, "v", "left_semi")
    near = near.unionByName(near.sparkSession.createDataFrame([(int(center),)], "v long")).distinct()
    inside = edges.join(near.withColumnRenamed("v", "src"), "src", "left_semi").join(near.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return bfs_tree(cut(inside.select("src", "dst")), center).select("v")


def subtree_sums(tree: DataFrame, costs: DataFrame) -> DataFrame:
    """(v, x): each node's cost plus that of all its descendants."""
    base = cut(tree.join(costs.withColumnRenamed("v", "node"), "node", "left").select("node", "parent", "level", F.coalesce("x", F.lit(0.0)).alias("x")))
    depth = base.agg(F.max("level")).first()[0] or 0
    row = base.where(F.col("level") == depth)
    out = row
    for level in range(depth - 1, -1, -1):
        add = row.groupBy(F.col("parent").alias("node")).agg(F.sum("x").alias("add"))
        row = base.where(F.col("level") == level).join(add, "node", "left").withColumn("x", F.col("x") + F.coalesce("add", F.lit(0.0))).drop("add")
        row = cut(row) if (depth - level) % EVERY == 0 else row
        out = out.unionByName(row)
    return out.select(F.col("node").alias("v"), "x")


def distances(tree: DataFrame) -> DataFrame:
    """(i, j, x): path lengths in the tree."""
    e = tree.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"), "w")
    return all_pairs(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))


def distortion(tree_distances: DataFrame, graph_distances: DataFrame) -> DataFrame:
    """(i, j, ratio) for i <> j: distance in the tree over distance in the graph."""
    return tree_distances.withColumnRenamed("x", "t").join(graph_distances.withColumnRenamed("x", "g"), ["i", "j"]).where("i <> j").select("i", "j", (F.col("t") / F.col("g")).alias("ratio"))


def histogram(values: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """(bin, lo, density): equal bins between the smallest and the largest value, the last one closed."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.when(width > 0, width).otherwise(1.0)), F.lit(bins - 1)).cast("long")
    counts = values.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))  # one row is sent
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(span))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.coalesce("c", F.lit(0)) / (F.col("n") * F.when(width > 0, width).otherwise(1.0))).alias("density"))


# ---- trees that approximate a metric -----------------------------------------------------


def frt(distances: DataFrame, beta: float, rank, trees: int = 1) -> DataFrame:
    """(tree_id, node, level, cluster): laminar clusters of radii beta * 2^i * w_min, from the top down.

    At each level a vertex joins, within its parent cluster, the first vertex in the order of
    ``rank(tree_id, v)`` (a Column) that is nearer than the radius. All vertices and trees of a
    level are one join and one minimum. Level 0 is everything; ``cluster`` names the path of centres.
    """
    span = distances.where("i <> j").agg(F.max("x").alias("far"), F.min("x").alias("near")).first()
    if span["far"] is None:
        raise ValueError("no pairs")
    near = span["near"] if span["near"] > 0 else 1.0
    top = max(0, math.ceil(math.log2(span["far"] / near)))
    ids = distances.sparkSession.range(trees).withColumnRenamed("id", "tree_id")
    order = ids.crossJoin(distances.select(F.col("j").alias("c")).distinct())
    order = cut(order.select("tree_id", "c", rank(F.col("tree_id"), F.col("c")).alias("r")))
    current = cut(ids.crossJoin(distances.select(F.col("i").alias("node")).distinct()).select("tree_id", "node", F.lit("r").alias("cluster")))
    out = current.select("tree_id", "node", F.lit(0).cast("long").alias("level"), "cluster")
    for level, i in enumerate(range(top, -1, -1), 1):
        reach = distances.where(F.col("x") < beta * 2.0**i * near).select(F.col("i").alias("node"), F.col("j").alias("c"))
        first = current.join(reach, "node").join(order, ["tree_id", "c"]).groupBy("tree_id", "node", "cluster").agg(F.min(F.struct("r", "c")).alias("m"))
        current = cut(first.select("tree_id", "node", F.concat_ws(">", "cluster", F.col("m.c").cast("string")).alias("cluster")))
        out = out.unionByName(current.select("tree_id", "node", F.lit(level).cast("long").alias("level"), "cluster"))
    return out


def frt_tree(clusters: DataFrame, near: float) -> DataFrame:
    """The tree of frt() clusters: vertices below the last level's clusters, every cluster a node with a negative id; an edge into level l weighs w_min * 2^(top - l + 1)."""
    top = clusters.agg(F.max("level")).first()[0]
    named = clusters.select("tree_id", "level", "cluster").distinct()
    named = cut(named.withColumn("id", -F.row_number().over(W.partitionBy("tree_id").orderBy("level", "cluster")).cast("long")))
    up = named.select("tree_id", (F.col("level") + 1).alias("level"), F.col("cluster").alias("p"), F.col("id").alias("parent"))
    inner = named.withColumn("p", F.regexp_replace("cluster", ">[^>]*$", "")).join(up, ["tree_id", "level", "p"], "left")
    w = F.when(F.col("parent").isNotNull(), near * F.pow(F.lit(2.0), top - F.col("level")))
    inner = inner.select("tree_id", F.col("id").alias("node"), "parent", w.alias("w"), "level")
    leaves = clusters.where(F.col("level") == top).join(named.select("tree_id", "level", "cluster", "id"), ["tree_id", "level", "cluster"])
    return inner.unionByName(leaves.select("tree_id", "node", F.col("id").alias("parent"), F.lit(near / 2).alias("w"), (F.col("level") + 1).alias("level")))


def bartal(edges: DataFrame, trees: int, seed: int = 0) -> DataFrame:
    """Trees by recursive low-diameter decomposition with geometric radii, one task for each tree (carving balls is sequential)."""
    rows = edges.sparkSession.range(trees).withColumnRenamed("id", "tree_id").crossJoin(edges.select("src", "dst", "w"))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        part = part.sort_values(["src", "dst"])
        ids = np.unique(part[["src", "dst"]].to_numpy())
        n = len(ids)
        a = np.full((n, n), np.inf)
        s, t = np.searchsorted(ids, part["src"]), np.searchsorted(ids, part["dst"])
        np.minimum.at(a, (s, t), part["w"])
        np.fill_diagonal(a, 0)
        near = part["w"].min()
        out: list[tuple] = []

        def carve(members: np.ndarray) -> int:
            """Add the members' tree; its root."""
            if len(members) == 1:
                return int(members[0])
            inside = _floyd(a[np.ix_(members, members)])
            size = float(inside[np.isfinite(inside)].max())
            p = min(1.0, 4 * math.log2(n) / (size / near)) if size > near else 1.0
            left, clusters = np.ones(len(members), bool), []
            while left.any():
                centre = int(rng.choice(np.flatnonzero(left)))
                radius = min(rng.geometric(p) * near, size / 2)
                ball = left & (inside[centre] < max(radius, near / 2))
                clusters.append(members[ball])
                left &= ~ball
            if len(clusters) == 1:
                clusters = [members[:1], members[1:]]
            roots = [carve(c) for c in clusters]
            for r in roots[1:]:
                out.append((r, roots[0], size))
            return roots[0]

        root = carve(np.arange(n))
        parent, weight = {c: p for c, p, _ in out}, {c: w for c, _, w in out}
        level = {root: 0}

        def depth(x):
            chain = []
            while x not in level:
                chain.append(x)
                x = parent[x]
            for y in reversed(chain):
                level[y] = level[parent[y]] + 1

        for x in range(n):
            depth(x)
        return pd.DataFrame({"tree_id": int(key[0]), "node": ids, "parent": [ids[parent[x]] if x in parent else None for x in range(n)], "w": [weight.get(x) for x in range(n)], "level": [level[x] for x in range(n)]}).astype({"parent": "Int64"})

    return rows.groupBy("tree_id").applyInPandas(one, TREE)


def _floyd(a: np.ndarray) -> np.ndarray:
    d = a.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k], out=d)
    return d


def random_spanning(edges: DataFrame, trees: int, seed: int = 0) -> DataFrame:
    """Uniform spanning trees of a connected graph by loop-erased random walks, one task for each tree."""
    rows = edges.sparkSession.range(trees).withColumnRenamed("id", "tree_id").crossJoin(edges.select("src", "dst", "w"))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        part = part.sort_values(["src", "dst"])
        near = {s: (g["dst"].to_numpy(), g["w"].to_numpy()) for s, g in part.groupby("src")}
        ids = sorted(near)
        root = ids[0]
        parent, weight = {root: None}, {root: None}
        for start in ids:
            step, x = {}, start
            while x not in parent:
                at = int(rng.integers(len(near[x][0])))
                step[x] = at
                x = int(near[x][0][at])
            x = start
            while x not in parent:
                at = step[x]
                parent[x], weight[x] = int(near[x][0][at]), float(near[x][1][at])
                x = parent[x]
        level = {root: 0}
        for x in ids:
            chain = []
            while x not in level:
                chain.append(x)
                x = parent[x]
            for y in reversed(chain):
                level[y] = level[parent[y]] + 1
        return pd.DataFrame({"tree_id": int(key[0]), "node": ids, "parent": [parent[x] for x in ids], "w": [weight[x] for x in ids], "level": [level[x] for x in ids]}).astype({"parent": "Int64"})

    return rows.groupBy("tree_id").applyInPandas(one, TREE)
