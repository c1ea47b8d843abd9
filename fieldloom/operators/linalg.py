"""Sparse matrices as (i, j, x) rows and vectors as (v, x) or (v, k, x) rows; an absent row is zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("x", F.col("x") * F.lit(float(by)))


def add(*parts: DataFrame) -> DataFrame:
    """Entry-wise sum; duplicates add up, as in sparse assembly."""
    out = parts[0].select("i", "j", "x")
    for p in parts[1:]:
        out = out.unionByName(p.select("i", "j", "x"))
    return out.groupBy("i", "j").agg(F.sum("x").alias("x"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """One equi-join on the inner index and one sum, partly combined before its shuffle."""
    left, right = a.select("i", F.col("j").alias("m"), F.col("x").alias("xa")), b.select(F.col("i").alias("m"), "j", F.col("x").alias("xb"))
    return left.join(right, "m").groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


def matvec(a: DataFrame, field: DataFrame) -> DataFrame:
    """(v, k, x): sum over j of a[v, j] * field[j, k]. The brute-force graph-field integration of a materialised kernel."""
    return a.join(field.select(F.col("v").alias("j"), "k", F.col("x").alias("f")), "j").groupBy(F.col("i").alias("v"), "k").agg(F.sum(F.col("x") * F.col("f")).alias("x"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("x", "y"), ["i", "j"]).select("i", "j", (F.col("x") * F.col("y")).alias("x"))


def outer(p: DataFrame, q: DataFrame) -> DataFrame:
    """p[i] * q[j] for all pairs: as many rows as the result has entries. The product is made through a constant key so that the planner may choose the side to send."""
    return p.select(F.col("v").alias("i"), F.col("x").alias("p")).crossJoin(q.select(F.col("v").alias("j"), F.col("x").alias("q"))).select("i", "j", (F.col("p") * F.col("q")).alias("x"))


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    return hadamard(a, b).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("i").alias("v")).agg(F.sum("x").alias("x"))


def col_sums(a: DataFrame) -> DataFrame:
    return row_sums(transpose(a))


def column_stochastic(a: DataFrame) -> DataFrame:
    """Columns divided by their sums."""
    sums = a.groupBy("j").agg(F.sum("x").alias("s"))
    return a.join(sums, "j").where("s <> 0").select("i", "j", (F.col("x") / F.col("s")).alias("x"))


def row_stochastic(a: DataFrame) -> DataFrame:
    return transpose(column_stochastic(transpose(a)))


def identity(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("v").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("x"))


def relative_difference(a: DataFrame, b: DataFrame, symmetric: bool = True) -> DataFrame:
    """||a - b|| / min(||a||, ||b||), or over ||b||, of fields (v, k, x)."""
    both = a.withColumnRenamed("x", "p").join(b.withColumnRenamed("x", "q"), ["v", "k"], "full").fillna(0.0, ["p", "q"])
    sums = both.agg(*[F.sqrt(F.sum(c * c)).alias(n) for n, c in (("d", F.col("p") - F.col("q")), ("na", F.col("p")), ("nb", F.col("q")))])
    return sums.select((F.col("d") / (F.least("na", "nb") if symmetric else F.col("nb"))).alias("x"))
