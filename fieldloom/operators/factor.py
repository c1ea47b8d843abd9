"""Integration through separators of separators; all parts of a depth are worked on together, keyed by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import integrators
from .stage import cut


def _within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends are members of one part: (g, src, dst, w)."""
    a, b = members.select("g", F.col("v").alias("src")), members.select(F.col("g").alias("h"), F.col("v").alias("dst"))
    return edges.join(a, "src").join(b, "dst").where("g = h").select("g", "src", "dst", "w")


def _reach(edges: DataFrame, start: DataFrame, hops: bool) -> DataFrame:
    """(g, v, d): distance from each part's start vertices, inside the part; in hops or in weight."""
    best = new = cut(start.select("g", "v", F.lit(0.0).alias("d")))
    step = F.lit(1.0) if hops else F.col("w")
    rounds = 0
    while True:
        rounds += 1
        far = new.join(edges.withColumnRenamed("src", "v"), ["g", "v"]).select("g", F.col("dst").alias("v"), F.round(F.col("d") + step, 9).alias("d")).groupBy("g", "v").agg(F.min("d").alias("d"))
        new = cut(far.join(best.withColumnRenamed("d", "old"), ["g", "v"], "left").where("old is null or d < old").select("g", "v", "d"))
        if new.isEmpty():
            return best
        best = best.unionByName(new)
        if not hops:
            best = best.groupBy("g", "v").agg(F.min("d").alias("d"))
        if not hops or rounds % 8 == 0:
            best = cut(best)


def by_levels(inside: DataFrame, members: DataFrame) -> DataFrame:
    """(g, v, part) of each part by the level of its BFS tree up to which more than half of its vertices lie."""
    level = members.join(_reach(inside, members.groupBy("g").agg(F.min("v").alias("v")), True), ["g", "v"], "left").withColumn("d", F.coalesce("d", F.lit(-1.0)))
    sizes = level.groupBy("g", "d").agg(F.count("*").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(W.partitionBy("g").orderBy("d"))).withColumn("all", F.sum("n").over(W.partitionBy("g")))
    middle = upto.where(2 * F.col("upto") > F.col("all")).groupBy("g").agg(F.min("d").alias("m"))
    return level.join(middle, "g").select("g", "v", F.when(F.col("d") < F.col("m"), 0).when(F.col("d") > F.col("m"), 1).otherwise(2).alias("part"))


def by_embedding(lists: DataFrame):
    """A finder for planar graphs: Lipton and Tarjan's separator of each part, from (v, adj) with neighbours in cyclic order. A part keeps the order of the neighbours it holds."""
    from . import planar

    def find(inside: DataFrame, members: DataFrame) -> DataFrame:
        near = members.join(lists, "v").select("g", "v", F.posexplode("adj").alias("nth", "w"))
        kept = near.join(members.select("g", F.col("v").alias("w")), ["g", "w"])
        around = kept.groupBy("g", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "w"))), lambda e: e["w"]).alias("adj"))
        rows = members.join(around, ["g", "v"], "left").select("g", "v", F.coalesce("adj", F.array().cast("array<bigint>")).alias("adj"), F.lit(1.0).alias("cost"))
        return planar.label(rows)

    return find


class RecursiveSeparator:
    """Any kernel of distance, through separators down to parts of less than ``threshold`` vertices, which are solved exactly.

    A part is split at the level of its BFS tree where half of its vertices are reached; the
    level's vertices are dealt to both sides. Across a split, vertices meet by slices of
    distance to the separator; inside, each side is a part of its own. Vertices keep their ids
    at every depth. A part that its separator does not split is solved exactly too. Paths that
    leave a part are not seen inside it, so distances there may be too long. ``finder`` is any
    other way to split: from edges (g, src, dst, w) and members (g, v) it gives (g, v, part), 2
    for the separator, no edge between 0 and 1. ``clustering`` gives the slice of a distance.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame, kernel, unit: float = 1.0, threshold: int = 500, shift: float = 0.0, depth: int = 20, finder=None, clustering=None):
        finder, clustering = finder or by_levels, clustering or (lambda d: F.floor(d / unit))
        self.args = edges, vertices, unit, threshold, shift, depth, finder, clustering
        self.kernel, self.unit, self.shift = kernel, unit, shift
        members, leaves, self.slices = cut(vertices.select(F.lit(1).cast("long").alias("g"), "v").distinct()), None, None
        for _ in range(depth):
            sized = members.withColumn("n", F.count("*").over(W.partitionBy("g")))
            small, active = sized.where(F.col("n") < threshold).select("g", "v"), cut(sized.where(F.col("n") >= threshold).select("g", "v"))
            leaves = small if leaves is None else leaves.unionByName(small)
            if active.isEmpty():
                members = active
                break
            inside = cut(_within(edges, active))
            part = cut(finder(inside, active))
            dealt = part.where("part = 2").withColumn("side", (F.row_number().over(W.partitionBy("g").orderBy("v")) % 2).cast("int")).select("g", "v", "side")
            side = part.where("part <> 2").select("g", "v", F.col("part").alias("side")).unionByName(dealt)
            split = side.groupBy("g").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("g")
            leaves = leaves.unionByName(side.join(split, "g", "left_anti").select("g", "v"))
            side = cut(side.join(split, "g", "left_semi"))
            distance = _reach(inside.join(split, "g", "left_semi"), part.where("part = 2").join(split, "g", "left_semi"), False)
            slices = distance.join(side, ["g", "v"]).select("g", "v", "side", clustering(F.col("d")).cast("long").alias("slice"))
            self.slices = slices if self.slices is None else self.slices.unionByName(slices)
            members = cut(side.select((2 * F.col("g") + F.col("side")).alias("g"), "v"))
        self.leaves = cut(leaves.unionByName(members))
        self.slices = cut(self.slices) if self.slices is not None else None
        ends = _within(edges, self.leaves).select("src", "dst", "w")
        alone = self.leaves.select("v")
        self.exact = integrators.BruteForce(ends, kernel, cut(integrators.all_pairs(ends, alone)))

    def squared(self) -> RecursiveSeparator:
        """The integrator of the kernel's squares."""
        edges, vertices, unit, threshold, shift, depth, finder, clustering = self.args
        return RecursiveSeparator(edges, vertices, lambda d: self.kernel(d) * self.kernel(d), unit, threshold, shift, depth, finder, clustering)

    def integrate(self, field: DataFrame) -> DataFrame:
        out = self.exact.integrate(field)
        if self.slices is not None:
            sums = field.join(self.slices, "v").groupBy("g", "side", "slice", "k").agg(F.sum("x").alias("f"))
            there = self.slices.select("g", (1 - F.col("side")).alias("side"), F.col("slice").alias("to")).distinct()
            weight = self.kernel((F.col("slice") + F.col("to") + self.shift) * self.unit)
            across = sums.join(there, ["g", "side"]).groupBy("g", (1 - F.col("side")).alias("side"), F.col("to").alias("slice"), "k").agg(F.sum(weight * F.col("f")).alias("x"))
            out = out.unionByName(self.slices.join(across, ["g", "side", "slice"]).select("v", "k", "x"))
        return out.groupBy("v", "k").agg(F.sum("x").alias("x"))
