"""Triangle meshes: points (v, pos) and faces (f, v0, v1, v2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import dot, euclidean
from . import linalg as la
from .stage import cut


def faces_to_edges(faces: DataFrame) -> DataFrame:
    """(src, dst): both directions of every side of a face, once. Faces have three corners v0..v2, or four, v0..v3, in order round them."""
    corners = [c for c in ("v0", "v1", "v2", "v3") if c in faces.columns]
    sides = faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])).alias("e"))
    one = sides.select(F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst")).distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def grid(spark, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(points, faces) of a w x h grid with two triangles in each cell and heights by integer arithmetic."""
    v = spark.range(width * height).withColumnRenamed("id", "v")
    x, y = (F.col("v") % width).cast("double"), F.floor(F.col("v") / width).cast("double")
    points = v.select("v", F.array(x, y, F.pmod(x * 7 + y * 13, F.lit(5.0)) / 10.0).alias("pos"))
    cell = spark.range((width - 1) * (height - 1)).withColumnRenamed("id", "c")
    a = F.floor(F.col("c") / (width - 1)) * width + F.col("c") % (width - 1)
    two = F.array(F.struct((2 * F.col("c")).alias("f"), a.alias("v0"), (a + 1).alias("v1"), (a + width).alias("v2")), F.struct((2 * F.col("c") + 1).alias("f"), (a + 1).alias("v0"), (a + width + 1).alias("v1"), (a + width).alias("v2")))
    return points, cell.select(F.inline(two))


def _corners(points: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for n in range(3):
        out = out.join(points.select(F.col("v").alias(f"v{n}"), F.col("pos").alias(f"p{n}")), f"v{n}")
    side = lambda a, b: euclidean(F.col(f"p{a}"), F.col(f"p{b}"))
    out = out.select("f", "v0", "v1", "v2", "p0", "p1", "p2", side(1, 2).alias("l0"), side(0, 2).alias("l1"), side(0, 1).alias("l2"))
    for n, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
        la, lb, ln = F.col(f"l{a}"), F.col(f"l{b}"), F.col(f"l{n}")
        cosine = (la * la + lb * lb - ln * ln) / (2 * la * lb)
        out = out.withColumn(f"c{n}", 0.5 / F.tan(F.acos(cosine)))
    return out


def cotangent_laplacian(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(i, j, x): minus half the cotangents across each side off the diagonal, their sums on it; a closed mesh's rows sum to 0."""
    c = _corners(points, faces)
    parts = [F.struct(F.col(f"v{i}").alias("i"), F.col(f"v{j}").alias("j"), (sign * F.col(f"c{n}")).alias("x")) for n, (a, b) in enumerate(((1, 2), (2, 0), (0, 1))) for i, j, sign in ((a, b, -1), (b, a, -1), (a, a, 1), (b, b, 1))]
    return c.select(F.inline(F.array(*parts))).groupBy("i", "j").agg(F.sum("x").alias("x"))


def vertex_areas(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, a): mixed Voronoi areas, scaled to sum 1. A triangle with an obtuse corner gives a half, a quarter and a quarter of its area."""
    c = _corners(points, faces)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    e1, e2 = minus("p0", "p1"), minus("p0", "p2")
    double = F.sqrt(F.greatest(dot(e1, e1) * dot(e2, e2) - dot(e1, e2) * dot(e1, e2), F.lit(0.0)))  # twice the triangle's area
    c = c.withColumn("d", double)
    voronoi = lambda n, a, b: (F.col(f"l{a}") * F.col(f"l{a}") * F.col(f"c{a}") + F.col(f"l{b}") * F.col(f"l{b}") * F.col(f"c{b}")) / 4
    share = lambda n: F.when(F.col(f"c{n}") < 0, F.col("d") / 4).when(F.least("c0", "c1", "c2") < 0, F.col("d") / 8).otherwise(voronoi(n, (n + 1) % 3, (n + 2) % 3))
    rows = c.select(F.inline(F.array(*[F.struct(F.col(f"v{n}").alias("v"), share(n).alias("a")) for n in range(3)])))
    sums = rows.groupBy("v").agg(F.sum("a").alias("a"))
    return sums.select("v", (F.col("a") / F.sum("a").over(W.partitionBy())).alias("a"))


def ordered_neighbours(faces: DataFrame) -> DataFrame:
    """(v, adj): neighbours in the cyclic order in which faces follow each other around a vertex, from the smallest. A closed mesh; an open fan starts at its free end."""
    corner = faces.select(F.inline(F.array(*[F.struct(F.col(a).alias("v"), F.col(b).alias("here"), F.col(c).alias("then")) for a, b, c in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1"))])))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        then = dict(zip(part["here"], part["then"], strict=True))
        starts = sorted(set(then) - set(then.values())) or [min(then)]
        ring = [starts[0]]
        while ring[-1] in then and then[ring[-1]] != ring[0] and len(ring) <= len(then):
            ring.append(then[ring[-1]])
        return pd.DataFrame({"v": [key[0]], "adj": [ring]})

    return corner.groupBy("v").applyInPandas(one, "v long, adj array<long>")


#: Vertices of a mesh that one task solves with a dense matrix (32 MB). Larger meshes take conjugate gradients by joins.
ONE_TASK = 2048


def heat(laplacian: DataFrame, areas: DataFrame, field: DataFrame, t: float, steps: int = 1, one_task: int = ONE_TASK) -> DataFrame:
    """(v, k, x): implicit heat steps (diag(a) + t / steps * L) x = a * x."""
    if areas.count() > one_task:
        matrix = cut(la.add(areas.select(F.col("v").alias("i"), F.col("v").alias("j"), F.col("a").alias("x")), la.scale(laplacian, t / steps)))
        for _ in range(steps):
            field = conjugate_gradients(matrix, field.join(areas, "v").select("v", "k", (F.col("x") * F.col("a")).alias("x")))
        return field
    rows = laplacian.select(F.lit(0).alias("kind"), "i", "j", "x")
    rows = rows.unionByName(areas.select(F.lit(1).alias("kind"), F.col("v").alias("i"), F.lit(0).cast("long").alias("j"), F.col("a").alias("x")))
    rows = rows.unionByName(field.select(F.lit(2).alias("kind"), F.col("v").alias("i"), F.col("k").cast("long").alias("j"), "x"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(part.loc[part["kind"] == 1, "i"])
        at = lambda k: part[part["kind"] == k]
        l, a = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        l[np.searchsorted(ids, at(0)["i"]), np.searchsorted(ids, at(0)["j"])] = at(0)["x"]
        a[np.searchsorted(ids, at(1)["i"])] = at(1)["x"]
        ks = np.unique(at(2)["j"])
        x = np.zeros((len(ids), len(ks)))
        x[np.searchsorted(ids, at(2)["i"]), np.searchsorted(ks, at(2)["j"])] = at(2)["x"]
        factor = np.linalg.cholesky(np.diag(a) + t / steps * l)
        for _ in range(steps):
            x = np.linalg.solve(factor.T, np.linalg.solve(factor, a[:, None] * x))
        return pd.DataFrame({"v": np.repeat(ids, len(ks)), "k": np.tile(ks, len(ids)).astype(np.int32), "x": x.ravel()})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "v long, k int, x double")


def conjugate_gradients(matrix: DataFrame, right: DataFrame, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """(v, k, x): the solution of a symmetric positive definite matrix (i, j, x) for each field column, all columns in the same joins, until residuals are ``tolerance`` of the right sides; two numbers of each column are collected in a round."""
    spark, kind = matrix.sparkSession, dict(right.dtypes)["k"]
    every = matrix.select(F.col("i").alias("v")).distinct().crossJoin(right.select("k").distinct())  # one row for each vertex and field column
    state = cut(every.join(right, ["v", "k"], "left").select("v", "k", F.lit(0.0).alias("x"), F.coalesce("x", F.lit(0.0)).alias("r"), F.coalesce("x", F.lit(0.0)).alias("p")))
    sums = lambda df, c: {r["k"]: r["s"] for r in df.groupBy("k").agg(F.sum(c).alias("s")).collect()}
    by = lambda values: F.broadcast(spark.createDataFrame([(k, float(x)) for k, x in values.items()], f"k {kind}, by double"))  # one row for each field column
    rest = sums(state, F.col("r") * F.col("r"))
    bound = {k: tolerance**2 * x for k, x in rest.items()}
    for _ in range(most):
        if all(rest[k] <= bound[k] for k in rest):
            return state.select("v", "k", "x")
        ap = la.matvec(matrix, state.select("v", "k", F.col("p").alias("x"))).withColumnRenamed("x", "ap")
        both = cut(state.join(ap, ["v", "k"]))
        down = sums(both, F.col("p") * F.col("ap"))
        step = {k: rest[k] / down[k] if down[k] > 0 else 0.0 for k in rest}
        moved = cut(both.join(by(step), "k").select("v", "k", (F.col("x") + F.col("by") * F.col("p")).alias("x"), (F.col("r") - F.col("by") * F.col("ap")).alias("r"), "p"))
        new = sums(moved, F.col("r") * F.col("r"))
        turn = {k: new[k] / rest[k] if rest[k] > 0 else 0.0 for k in rest}
        state = moved.join(by(turn), "k").select("v", "k", "x", "r", (F.col("r") + F.col("by") * F.col("p")).alias("p"))
        rest = new
    raise ArithmeticError(f"no solution after {most} rounds")


def vertex_normals(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, normal): unit sums of the normals of a vertex's faces, weighted by their areas."""
    at = lambda n: points.select(F.col("v").alias(f"v{n}"), F.col("pos").alias(f"p{n}"))
    rows = faces
    for n in range(3):
        rows = rows.join(at(n), f"v{n}")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    rows = rows.select("v0", "v1", "v2", minus("p1", "p0").alias("e"), minus("p2", "p0").alias("f"))
    cross = [F.col("e")[(d + 1) % 3] * F.col("f")[(d + 2) % 3] - F.col("e")[(d + 2) % 3] * F.col("f")[(d + 1) % 3] for d in range(3)]
    each = rows.select(F.explode(F.array("v0", "v1", "v2")).alias("v"), *[c.alias(f"n{d}") for d, c in enumerate(cross)])
    sums = each.groupBy("v").agg(*[F.sum(f"n{d}").alias(f"n{d}") for d in range(3)])
    size = F.sqrt(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2"))
    return sums.withColumn("s", size).select("v", F.array(*[F.when(F.col("s") > 0, F.col(f"n{d}") / F.col("s")).otherwise(0.0) for d in range(3)]).alias("normal"))


def snapshot(frames: DataFrame, types: int = 9) -> DataFrame:
    """Frames (traj_id, t, v, world_pos, prev_world_pos, node_type) with features: velocity and the one-hot node type."""
    velocity = F.zip_with("world_pos", "prev_world_pos", lambda a, b: a - b)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(types - 1)), lambda n: F.when(n == F.col("node_type"), 1.0).otherwise(0.0))
    return frames.withColumn("features", F.concat(velocity, one_hot))


def snapshot_edges(frames: DataFrame, edges: DataFrame, keys: list[str], position: str = "world_pos") -> DataFrame:
    """(keys..., src, dst, relative, length): for each frame, what each edge (src, dst) spans; ``keys`` name a frame."""
    end = lambda x: frames.select(*keys, F.col("v").alias(x), F.col(position).alias(f"p_{x}"))
    both = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), [*keys, "dst"])
    return both.select(*keys, "src", "dst", F.zip_with("p_src", "p_dst", lambda a, b: a - b).alias("relative"), euclidean(F.col("p_src"), F.col("p_dst")).alias("length"))


def lag_lead(frames: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Each frame with the value before and after it; the first and last of a key go."""
    w = W.partitionBy(*key).orderBy(*[order] if isinstance(order, str) else order)
    return frames.withColumn("prev", F.lag(value).over(w)).withColumn("target", F.lead(value).over(w)).where("prev is not null and target is not null")


def noisy(frames: DataFrame, sigma: float = 0.003, gamma: float = 0.1, seed: int = 0) -> DataFrame:
    """World positions of type-0 nodes with seeded noise; targets move by (1 - gamma) of it where there are any."""
    noise = F.transform("world_pos", lambda x: x * 0 + F.when(F.col("node_type") == 0, F.randn(seed) * sigma).otherwise(0.0))
    out = frames.withColumn("_n", noise).withColumn("world_pos", F.zip_with("world_pos", "_n", lambda a, b: a + b))
    if "target_world_pos" in frames.columns:
        out = out.withColumn("target_world_pos", F.zip_with("target_world_pos", "_n", lambda a, b: a + (1 - gamma) * b))
    return out.drop("_n")


def voxels(points: DataFrame, size: float) -> DataFrame:
    """(cell, n, pos): the mean position of the points in each cube."""
    cell = F.transform("pos", lambda x: F.floor(x / size).cast("long"))
    dims = points.select(cell.alias("cell"), F.posexplode("pos").alias("d", "x"))
    means = dims.groupBy("cell", "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("cell").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("pos"))


def histogram_3d(points: DataFrame, bins: int, lo: float = -1.0, hi: float = 1.0, floor: float = 1e-10) -> DataFrame:
    """(x, y, z, mass) on a full grid of bins: shares of points, the last bin of an axis closed, plus a floor, scaled to sum 1. Points outside are left out."""
    width = (hi - lo) / bins
    axis = lambda d: F.least(F.floor((F.col("pos")[d] - lo) / width), F.lit(bins - 1)).cast("long")
    inside = points.where(F.forall("pos", lambda x: (x >= lo) & (x <= hi)))
    counts = inside.groupBy(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z")).agg(F.count("*").alias("c"))
    total = inside.agg(F.count("*").alias("n"))
    cells = points.sparkSession.range(bins**3).select((F.col("id") % bins).alias("x"), (F.floor(F.col("id") / bins) % bins).alias("y"), F.floor(F.col("id") / bins**2).cast("long").alias("z"))
    mass = cells.join(counts, ["x", "y", "z"], "left").crossJoin(F.broadcast(total)).select("x", "y", "z", (F.coalesce("c", F.lit(0)) / F.col("n") + floor).alias("mass"))
    return mass.withColumn("mass", F.col("mass") / F.lit(1 + floor * bins**3))
