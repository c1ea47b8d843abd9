"""A kernel applied to a stream of field changes.

Integration is linear, so the integral of a field is the sum of the integrals of its changes:
each micro-batch joins the static kernel and adds to running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def integrate(changes: DataFrame, kernel: DataFrame) -> DataFrame:
    """(v, k, x): running integrals of a stream of changes (v, k, x) through a static kernel (i, j, x); for output modes update and complete."""
    joined = changes.join(kernel.select("i", F.col("j").alias("v"), F.col("x").alias("w")), "v")
    return joined.groupBy(F.col("i").alias("v"), "k").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def windowed(changes: DataFrame, kernel: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The same for each time window of the changes, which also have a ``time`` column; changes later than ``late`` are dropped with their window's state."""
    joined = changes.withWatermark(time, late).join(kernel.select("i", F.col("j").alias("v"), F.col("x").alias("w")), "v")
    return joined.groupBy(F.window(time, width).alias("window"), F.col("i").alias("v"), "k").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
