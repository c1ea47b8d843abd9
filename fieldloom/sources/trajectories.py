"""Trajectories from TFRecord files, and their frames."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Array types that a meta.json names.
DTYPES = {"float32": "<f4", "float64": "<f8", "int32": "<i4", "int64": "<i8"}


def records(data: bytes):
    """The payloads of a TFRecord file: length, its checksum, payload, its checksum."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack("<Q", data[at : at + 8])
        yield data[at + 12 : at + 12 + n]
        at += 16 + n


def _fields(data: bytes):
    """(number, value) of a protocol-buffers message: integers, or bytes of nested ones."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            size = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


def example(data: bytes) -> dict[str, list[bytes]]:
    """Byte-list features by name of one serialised example."""
    out = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            lists = [v for _, one in _fields(parts[2]) for _, v in _fields(one)] if 2 in parts else []
            out[parts[1].decode()] = lists
    return out


def arrays(data: bytes, meta: dict) -> dict[str, np.ndarray]:
    """Features as arrays of the declared shapes; static ones are repeated for each time step, ragged ones end as flat arrays."""
    got, out = example(data), {}
    for name, spec in meta["features"].items():
        raw = b"".join(got.get(name, []))
        x = np.frombuffer(raw, DTYPES[spec["dtype"]])
        if spec["type"] != "dynamic_varlen":
            x = x.reshape(spec["shape"])
        if spec["type"] == "static":
            x = np.repeat(x.reshape(1, *x.shape[-2:]), meta["trajectory_length"], 0)
        out[name] = x
    return out


def read(spark: SparkSession, path: str, meta: str | dict) -> DataFrame:
    """(file, traj, t, v, world_pos, mesh_pos, node_type, more) rows of all trajectories in TFRecord files under ``path``; ``more`` maps the names of other features of vertices to their values."""
    meta = json.loads(meta) if isinstance(meta, str) else meta

    def run(batches):
        for name, n, a in _trajectories(batches, meta):
            steps, size = a["world_pos"].shape[:2]
            each = {k: x.reshape(steps * size, -1) for k, x in a.items() if x.ndim == 3 and x.shape[:2] == (steps, size) and k != "cells"}
            wide = lambda k: list(each[k].astype(float)) if k in each else [[]] * (steps * size)  # noqa: B023, E731
            others = [k for k in each if k not in ("world_pos", "mesh_pos", "node_type")]
            more = [dict(zip(others, x, strict=True)) for x in zip(*[each[k].astype(float).tolist() for k in others], strict=True)] if others else [{}] * (steps * size)
            kind = each["node_type"][:, 0].astype(np.int32) if "node_type" in each else np.zeros(steps * size, np.int32)
            yield pd.DataFrame({"file": name, "traj": n, "t": np.repeat(np.arange(steps), size), "v": np.tile(np.arange(size), steps), "world_pos": wide("world_pos"), "mesh_pos": wide("mesh_pos"), "node_type": kind, "more": more})

    schema = "file string, traj long, t long, v long, world_pos array<double>, mesh_pos array<double>, node_type int, more map<string,array<double>>"
    return _files(spark, path).mapInPandas(run, schema)


def read_cells(spark: SparkSession, path: str, meta: str | dict) -> DataFrame:
    """(file, traj, f, corners): the cells of each trajectory's mesh, which are those of its first frame."""
    meta = json.loads(meta) if isinstance(meta, str) else meta

    def run(batches):
        for name, n, a in _trajectories(batches, meta):
            if "cells" in a:
                cells = a["cells"][0] if a["cells"].ndim == 3 else a["cells"]
                yield pd.DataFrame({"file": name, "traj": n, "f": np.arange(len(cells)), "corners": list(cells.astype(np.int64))})

    return _files(spark, path).mapInPandas(run, "file string, traj long, f long, corners array<long>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").endswith(".tfrecord")).select("path", "content")


def _trajectories(batches, meta: dict):
    """(file, number in the file, arrays) of each record."""
    for batch in batches:
        for name, data in zip(batch["path"], batch["content"], strict=True):
            for n, record in enumerate(records(data)):
                yield name, n, arrays(record, meta)
