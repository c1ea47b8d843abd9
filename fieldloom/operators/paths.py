"""Shortest paths, traversals and components, as loops of joins that stop at the fixpoint."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stage import cut


def all_pairs(edges: DataFrame, sources: DataFrame | None = None, limit: float | None = None, digits: int = 9) -> DataFrame:
    """(i, j, x): shortest distances from every (or every given) vertex, 0 to itself; unreachable pairs are absent.

    Frontier relaxation: each round joins only the pairs that got shorter with the edges, so a
    sparse graph costs its edges times its reached pairs, not the cube of its size. Distances
    are rounded to ``digits`` so that sums in another order compare equal. ``limit`` leaves out
    longer paths.
    """
    sources = sources if sources is not None else edges.select(F.col("src").alias("v")).distinct()
    best = cut(sources.select(F.col("v").alias("i"), F.col("v").alias("j"), F.lit(0.0).alias("x")))
    new = best
    step = edges.select(F.col("src").alias("j"), F.col("dst").alias("t"), "w")
    while True:
        reach = new.join(step, "j").select("i", F.col("t").alias("j"), F.round(F.col("x") + F.col("w"), digits).alias("x"))
        reach = reach.where(F.col("x") <= limit) if limit is not None else reach
        reach = reach.groupBy("i", "j").agg(F.min("x").alias("x"))
        new = cut(reach.join(best.withColumnRenamed("x", "old"), ["i", "j"], "left").where("old is null or x < old").select("i", "j", "x"))
        if new.isEmpty():
            return best
        best = cut(best.unionByName(new).groupBy("i", "j").agg(F.min("x").alias("x")))


def multi_source(edges: DataFrame, sources: DataFrame, digits: int = 9) -> DataFrame:
    """(v, d): distance to the nearest of ``sources`` (v)."""
    best = cut(sources.select("v", F.lit(0.0).alias("d")).distinct())
    new = best
    while True:
        reach = new.join(edges.select(F.col("src").alias("v"), "dst", "w"), "v").select(F.col("dst").alias("v"), F.round(F.col("d") + F.col("w"), digits).alias("d")).groupBy("v").agg(F.min("d").alias("d"))
        new = cut(reach.join(best.withColumnRenamed("d", "old"), "v", "left").where("old is null or d < old").select("v", "d"))
        if new.isEmpty():
            return best
        best = cut(best.unionByName(new).groupBy("v").agg(F.min("d").alias("d")))


def bfs_tree(edges: DataFrame, root: int) -> DataFrame:
    """(v, level, parent): levels from the root; the parent is the smallest neighbour one level up, null for the root."""
    seen = cut(edges.sparkSession.createDataFrame([(int(root), 0, None)], "v long, level long, parent long"))
    new, level = seen, 0
    while True:
        level += 1
        reach = new.select(F.col("v").alias("src")).join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
        new = cut(reach.join(seen.select("v"), "v", "left_anti").select("v", F.lit(level).cast("long").alias("level"), "parent"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        if level % 8 == 0:
            seen = cut(seen)


#: Links that one task settles: 16 bytes each. A larger table is contracted by rounds of joins first.
ONE_TASK = 1 << 20


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links (u, v), and the smallest vertex that each reaches."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _settled(links: DataFrame) -> DataFrame:
    """(v, component) of at most ONE_TASK links (u, v), by one task."""

    def run(batches):
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            ids, low = smallest_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["v", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, "v long, component long")


def components(vertices: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(v, component): the smallest vertex reachable.

    Up to ``one_task`` links are settled by one task, however long their chains. More are contracted
    first: each round links a vertex's larger neighbours, and then the vertex itself and its smaller
    ones, to the smallest of them, so a chain shrinks by a constant factor, and there are never more links.
    """
    ends = edges.select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v")).where("u <> v")
    links = cut(ends.distinct())
    mark = lambda: tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, now = None, mark()
    while now[0] > one_task and now != seen:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a link whose smaller end has nothing smaller stays
        large = cut(large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen, now = now, mark()
    found = _settled(links) if now[0] <= one_task else links.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return vertices.select("v").join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
