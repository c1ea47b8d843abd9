"""Results and frames to files and back, and grids of parameters from configuration files."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_snapshots(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Frames as Parquet by traj_id: a reader of one trajectory reads its folder only."""
    frames.write.partitionBy("traj_id").mode(mode).parquet(path)


def read_snapshots(spark: SparkSession, path: str, trajectories: list[int] | None = None) -> DataFrame:
    frames = spark.read.parquet(path)
    return frames if trajectories is None else frames.where(F.col("traj_id").isin(trajectories))


def write(result: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """A result as parquet, csv (with a header) or json lines."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind {kind}; known: parquet, csv, json")
    out = result.write.mode(mode)
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def log(spark: SparkSession, path: str, *lines: str) -> None:
    """Lines appended to a log: a text file for each call, in the folder ``path``."""
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("append").text(path)


def config(text: str) -> dict:
    """A configuration in JSON, or in YAML where its library is there."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and there is no YAML library") from e
        return yaml.safe_load(text)


def grid(spark: SparkSession, methods: dict) -> DataFrame:
    """(method, parameters): every combination of each method's lists of values, {"method": {"sigma": [1, 2], "eps": 0.1}}; single values stay."""
    rows = []
    for name, options in methods.items():
        keys, lists = list(options), [x if isinstance(x, list) else [x] for x in options.values()]
        rows += [(name, {k: float(x) for k, x in zip(keys, values, strict=True)}) for values in itertools.product(*lists)]
    return spark.createDataFrame(rows, "method string, parameters map<string,double>")
