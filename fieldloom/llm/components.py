"""Connected components of a link table: star contractions down to what one task can settle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


#: Links that one task settles: 16 bytes each. A larger table is contracted by rounds of joins first.
ONE_TASK = 1 << 20
_NODES = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (u, v), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _settled(edges: DataFrame) -> DataFrame:
    """(node, component) of at most ONE_TASK links, by one task."""

    def run(batches):
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            nodes, low = smallest_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], schema=_NODES)

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node that a link names; component is the smallest node reachable.

    Links that are more than ``one_task`` are contracted first: large-star and small-star steps
    replace each node's links by links to the smallest neighbour, so a chain shrinks by a
    constant factor each round and a star stays as it is. Each step is one ``min`` per node
    (combined before the shuffle) and one join whose large side Spark may split, so a node with
    very many links needs no task of its own. The table never exceeds the number of links; it
    is cut to the shared folder each round and only its size and checksum reach the driver.
    What is left, or was no more from the start, one task settles. Null ends and loops are left
    out; an empty table gives no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(edges)
    for _ in range(rounds if seen[0] > one_task else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # an edge whose smaller end keeps nothing larger stays with that end's minimum
        large = large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == seen:  # stars, each around its smallest node
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
        if seen[0] <= one_task:
            break
    else:
        if seen[0] > one_task:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _settled(edges)


def ceil_div(x: Column, by: int) -> Column:
    return F.floor((x + (by - 1)) / F.lit(by)).cast("long")
