"""Generated graphs and clouds; the same for the same seed on any number of machines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def normal(*key: Column, seed: int = 0) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(*key, seed=seed))) * F.cos(2 * math.pi * uniform(*key, seed=seed + 7919))


def cloud(spark: SparkSession, n: int, dim: int = 3, seed: int = 0, gaussian: bool = True) -> DataFrame:
    """(v, pos)."""
    draw = normal if gaussian else uniform
    return spark.range(n).select(F.col("id").alias("v"), F.array(*[draw(F.col("id"), F.lit(d), seed=seed) for d in range(dim)]).alias("pos"))


def random_tree(spark: SparkSession, n: int, high: float = 10.0, seed: int = 0) -> DataFrame:
    """Edges of a tree in which vertex v hangs below a random smaller one; weights up to ``high``."""
    half = spark.range(1, n).select(F.col("id").alias("src"), F.floor(uniform(F.col("id"), seed=seed) * F.col("id")).cast("long").alias("dst"), (high * uniform(F.col("id"), seed=seed + 1)).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Each pair is an edge with probability p; one row for each vertex is spread over its smaller partners."""
    pairs = spark.range(1, n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("dst"))
    half = pairs.where(uniform(F.col("src"), F.col("dst"), seed=seed) < p).withColumn("w", F.lit(1.0))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def known_mask(vertices: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """(v): about ``ratio`` of the vertices, the same ones each time."""
    return vertices.where(uniform(F.col("v"), seed=seed) < ratio).select("v")


def geometric(spark: SparkSession, n: int, radius: float, dim: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(points, edges): uniform points of the unit cube, joined up to ``radius`` apart."""
    from ..operators.graphs import epsilon_graph

    points = cloud(spark, n, dim, seed, gaussian=False)
    return points, epsilon_graph(points, radius, "euclidean")


def regular(spark: SparkSession, n: int, degree: int = 5, seed: int = 0) -> DataFrame:
    """Edges of a regular graph: a ring in which each vertex meets its nearest ones on both sides (and, for an odd degree, the opposite one), its vertices named at random."""
    if degree >= n or (degree % 2 and n % 2):
        raise ValueError(f"no graph of {n} vertices has degree {degree}")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(uniform(F.col("id"), seed=seed), "id")) - 1  # n rows of two numbers
    names = spark.range(n).select(F.col("id").alias("v"), place.cast("long").alias("at"))
    steps = [*range(1, degree // 2 + 1), *([n // 2] if degree % 2 else [])]
    ring = spark.range(n).select(F.col("id").alias("a"), F.explode(F.array(*[F.pmod(F.col("id") + s, F.lit(n)) for s in steps])).alias("b"))
    end = lambda x, y: names.select(F.col("v").alias(y), F.col("at").alias(x))
    half = ring.join(end("a", "src"), "a").join(end("b", "dst"), "b").select("src", "dst", F.lit(1.0).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct()


def choices(vertices: DataFrame, sets: int, size: int, seed: int = 0) -> DataFrame:
    """(set_id, v): random sets of ``size`` of the vertices (v), the same ones each time."""
    from pyspark.sql import Window as W

    drawn = vertices.sparkSession.range(sets).withColumnRenamed("id", "set_id").crossJoin(vertices.select("v"))  # each set ranks all vertices
    rank = F.row_number().over(W.partitionBy("set_id").orderBy(uniform(F.col("set_id"), F.col("v"), seed=seed), "v"))
    return drawn.withColumn("r", rank).where(F.col("r") <= size).select("set_id", "v")


def geometric_number(p: float, *key: Column, seed: int = 0) -> Column:
    """A draw of the geometric distribution (1, 2, ...) with success chance p."""
    return (F.floor(F.log(1 - uniform(*key, seed=seed)) / math.log(1 - p)) + 1).cast("long")
