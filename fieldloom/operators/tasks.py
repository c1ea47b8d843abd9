"""Tasks on fields: masked interpolation, its metrics, parameter grids, cloud classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dense


def interpolate(integrator, field: DataFrame, known: DataFrame) -> DataFrame:
    """(v, k, x) at unknown vertices: the integral of the field with unknown values at zero."""
    out = integrator.integrate(field.join(known.select("v"), "v", "left_semi"))
    return out.join(known.select("v"), "v", "left_anti")


def interpolate_normalised(integrator, field: DataFrame, known: DataFrame, eps: float = 0.0) -> DataFrame:
    """Kernel-weighted means of known values: the integral of the field over that of ones."""
    there = field.join(known.select("v"), "v", "left_semi")
    above = integrator.integrate(there)
    below = integrator.integrate(there.select("v", F.lit(0).alias("k")).distinct().withColumn("x", F.lit(1.0)))
    out = above.join(below.select("v", F.col("x").alias("s")), "v").where(F.col("s") + eps != 0).select("v", "k", (F.col("x") / (F.col("s") + eps)).alias("x"))
    return out.join(known.select("v"), "v", "left_anti")


def neighbour_means(edges: DataFrame, field: DataFrame, known: DataFrame, kernels: dict[float, Column]) -> DataFrame:
    """(p, v, k, x): for each parameter p, kernel-weighted means over known neighbours. All parameters share one join."""
    near = edges.join(known.select(F.col("v").alias("dst")), "dst", "left_semi").join(known.select(F.col("v").alias("src")), "src", "left_anti")
    grid = F.explode(F.map_from_arrays(F.array(*[F.lit(float(p)) for p in kernels]), F.array(*kernels.values()))).alias("p", "w")
    weights = near.select("src", "dst", grid)
    below = weights.groupBy("p", "src").agg(F.sum("w").alias("s"))
    above = weights.join(field.select(F.col("v").alias("dst"), "k", "x"), "dst").groupBy("p", "src", "k").agg(F.sum(F.col("w") * F.col("x")).alias("t"))
    return above.join(below, ["p", "src"]).select("p", F.col("src").alias("v"), "k", (F.col("t") / F.col("s")).alias("x"))


def metrics(predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., frobenius, cosine): the norm of the difference, and the mean cosine of vertices' vectors, over vertices that have a prediction. Absent entries are zeros."""
    by = by or []
    there = predicted.select(*by, "v").distinct()
    want = there.join(truth.withColumnRenamed("x", "y"), "v")
    both = want.join(predicted, [*by, "v", "k"], "full").fillna(0.0, ["x", "y"])
    rows = both.groupBy(*by, "v").agg(F.sum((F.col("x") - F.col("y")) ** 2).alias("d"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"))
    cosine = F.when(F.col("xx") * F.col("yy") > 0, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.sqrt(F.sum("d")).alias("frobenius"), F.avg(cosine).alias("cosine"))


def method_grid(methods: dict, field: DataFrame, known: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(method, parameter, frobenius, cosine): normalised interpolation of unknown vertices by each integrator of {(method, parameter): integrator}, against the field."""
    out = None
    for (name, value), integrator in methods.items():
        part = metrics(interpolate_normalised(integrator, field, known, eps), field).select(F.lit(name).alias("method"), F.lit(float(value)).alias("parameter"), "frobenius", "cosine")
        out = part if out is None else out.unionByName(part)
    return out


def best_of_grid(grid: DataFrame) -> DataFrame:
    """(method, parameter, cosine): each method's parameter with the largest cosine, the smallest of equals."""
    best = grid.groupBy("method").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "parameter")).alias("b"))
    return best.select("method", F.col("b.parameter").alias("parameter"), (-F.col("b.c")).alias("cosine"))


class Evaluator:
    """Seconds and the driver's peak memory of named pieces of work."""

    def __init__(self):
        self.rows: list[tuple[str, float, float]] = []

    def measure(self, name: str, work):
        """What ``work()`` returns; a DataFrame is computed whole for the timing."""
        import resource
        import time

        began = time.perf_counter()
        out = work()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        self.rows.append((name, time.perf_counter() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))
        return out

    def table(self, spark) -> DataFrame:
        """(name, seconds, peak_mb) in the order of measuring."""
        return spark.createDataFrame([(n, *r) for n, r in enumerate(self.rows)], "nth int, name string, seconds double, peak_mb double")


def extent(field: DataFrame) -> DataFrame:
    """(k, least, most) of each field column; no rows for an empty field."""
    return field.groupBy("k").agg(F.min("x").alias("least"), F.max("x").alias("most"))


def support(hist: DataFrame, bound: float, value: str = "x") -> DataFrame:
    """The cells of a histogram with more than ``bound``."""
    return hist.where(F.col(value) > bound)


def mean_squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("x", "p").join(b.withColumnRenamed("x", "q"), "v").agg(F.avg((F.col("p") - F.col("q")) ** 2).alias("x"))


def spectrum(points: DataFrame, k: int = 32, eps: float = 0.1, rate: float = -0.1) -> DataFrame:
    """(g, features): the k smallest eigenvalues of exp(rate * A) for each cloud (g, v, pos), A its L1 distances up to eps; padded with the last. One task for each cloud."""

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part.sort_values("v")["pos"].tolist(), float)
        d = np.abs(x[:, None] - x[None]).sum(2)
        values = np.sort(np.exp(rate * np.linalg.eigvalsh(np.where(d <= eps, d, 0.0))))[:k]
        return pd.DataFrame({"g": [key[0]], "features": [np.concatenate([values, np.full(k - len(values), values[-1])]).tolist()]})

    return points.groupBy("g").applyInPandas(one, "g long, features array<double>")


def classify(features: DataFrame, train: Column, seed: int = 0, depth: int = 10, trees: int = 20) -> DataFrame:
    """(g, y, predicted) for the rows that are not in ``train``, by a random forest over (g, features, y)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = features.select("g", array_to_vector("features").alias("features"), F.col("y").cast("double").alias("y"), train.alias("train"))
    model = RandomForestClassifier(featuresCol="features", labelCol="y", predictionCol="predicted", seed=seed, maxDepth=depth, numTrees=trees).fit(rows.where("train"))
    return model.transform(rows.where("not train")).select("g", "y", "predicted")


def nonzero_per_row(a: DataFrame) -> DataFrame:
    """(x): mean number of non-zero entries of a row."""
    return a.where("x <> 0").groupBy("i").agg(F.count("*").alias("n")).agg(F.avg("n").alias("x"))


is_psd = dense.is_psd
