"""Kernels kept as Parquet by kernel id, and a catalogue of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import kernels


class KernelStore:
    """Matrices (i, j, x) by kernel id under one folder; a reader of some ids reads only their partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, found: dict[str, DataFrame], mode: str = "append") -> None:
        for kid, k in found.items():
            k.select("i", "j", "x", F.lit(kid).alias("kid")).write.partitionBy("kid").mode(mode).parquet(self.path)

    def load(self, kid: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("kid") == kid).select("i", "j", "x")

    def ids(self) -> list[str]:
        return sorted(r[0] for r in self.spark.read.parquet(self.path).select("kid").distinct().collect())

    def get(self, kid: str, adjacency: DataFrame) -> DataFrame:
        """The stored kernel, or the one made from the adjacency, which is then stored."""
        try:
            if kid in self.ids():
                return self.load(kid)
        except Exception as e:  # no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        self.save({kid: kernels.by_name(adjacency, kid)})
        return self.load(kid)
