"""Mesh files (OBJ, OFF, PLY and STL, in text or binary) as points and faces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stage import cut


def parse(name: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vertices (n, 3), faces (m, 3)); faces with more corners become fans. The kind follows the name's ending."""
    kind = name.lower().rsplit(".", 1)[-1]
    if kind == "stl":
        corners = _stl(data)
        vertices, index = np.unique(corners, axis=0, return_inverse=True)
        return vertices, index.reshape(-1, 3)
    if kind == "ply" and b"format binary" in data[:200]:
        return _binary_ply(data)
    lines = [x.split() for x in data.decode("utf-8", "replace").splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if kind == "obj":
        vertices = [x[1:4] for x in lines if x[0] == "v"]
        n = len(vertices)
        corner = lambda c: (i - 1 if (i := int(c.split("/")[0])) > 0 else n + i)
        polygons = [[corner(c) for c in x[1:]] for x in lines if x[0] == "f"]
    elif kind == "off":
        if lines[0][0] == "OFF":
            lines[0] = lines[0][1:]
        lines = [x for x in lines if x]
        n, m = int(lines[0][0]), int(lines[0][1])
        vertices = [x[:3] for x in lines[1 : n + 1]]
        polygons = [list(map(int, x[1 : int(x[0]) + 1])) for x in lines[n + 1 : n + m + 1]]
    elif kind == "ply":
        count = {x[1]: int(x[2]) for x in lines if x[0] == "element"}
        at = next(i for i, x in enumerate(lines) if x[0] == "end_header") + 1
        vertices = [x[:3] for x in lines[at : at + count["vertex"]]]
        at += count["vertex"]
        polygons = [list(map(int, x[1 : int(x[0]) + 1])) for x in lines[at : at + count.get("face", 0)]]
    else:
        raise ValueError(f"unknown mesh format: {name}")
    fans = [(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)]
    return np.array(vertices, float).reshape(-1, 3), np.array(fans, np.int64).reshape(-1, 3)


#: Number types that a PLY header names.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _binary_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices with scalar properties, then faces whose first property is the list of corners; elements after these are not read."""
    end = data.index(b"end_header") + len(b"end_header\n")
    head = [x.split() for x in data[:end].decode("ascii").splitlines()]
    order = "<" if "binary_little_endian" in head[1] else ">"
    elements: list[tuple[str, int, list]] = []
    for x in head:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    vertices, polygons, at = np.zeros((0, 3)), [], end
    for name, count, properties in elements:
        if all(p[0] != "list" for p in properties):
            kind = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties])
            rows = np.frombuffer(data, kind, count, at)
            at += kind.itemsize * count
            if name == "vertex":
                vertices = np.stack([rows[c].astype(float) for c in "xyz"], 1)
            continue
        for _ in range(count):
            for n, p in enumerate(properties):
                if p[0] != "list":
                    at += np.dtype(PLY_TYPES[p[0]]).itemsize
                    continue
                size, item = np.dtype(order + PLY_TYPES[p[1]]), np.dtype(order + PLY_TYPES[p[2]])
                many = int(np.frombuffer(data, size, 1, at)[0])
                at += size.itemsize
                if name == "face" and n == 0:
                    polygons.append(np.frombuffer(data, item, many, at).tolist())
                at += item.itemsize * many
        if name == "face":
            break
    return vertices, np.array([(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)], np.int64).reshape(-1, 3)


def _stl(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[80:84], "little") if len(data) >= 84 else -1
    if len(data) == 84 + 50 * count:
        rows = np.frombuffer(data, np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("tag", "<u2")]), count, 84)
        return rows["corners"].reshape(-1, 3).astype(float)
    return np.array([x.split()[1:4] for x in data.decode("ascii", "replace").splitlines() if x.strip().startswith("vertex")], float).reshape(-1, 3)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points (graph_id, v, pos), faces (graph_id, f, v0, v1, v2)) of all mesh files under ``path``; graph_id is the file's path. Each file is parsed once, by one task, and kept in the shared folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                v, f = parse(name, data)
                yield pd.DataFrame({"graph_id": name, "at": np.arange(len(v)), "pos": list(v), "corners": None})
                yield pd.DataFrame({"graph_id": name, "at": np.arange(len(f)), "pos": None, "corners": list(f)})

    both = cut(files.mapInPandas(run, "graph_id string, at long, pos array<double>, corners array<long>"))
    points = both.where("pos is not null").select("graph_id", F.col("at").alias("v"), "pos")
    return points, both.where("corners is not null").select("graph_id", F.col("at").alias("f"), *[F.col("corners")[n].alias(f"v{n}") for n in range(3)])


def to_obj(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(line) rows of an OBJ file in order: one sorted text column, ready for ``coalesce(1).write.text``."""
    v = points.select(F.lit(0).alias("part"), F.col("v").alias("at"), F.concat_ws(" ", F.lit("v"), *[F.col("pos")[i].cast("string") for i in range(3)]).alias("line"))
    f = faces.select(F.lit(1).alias("part"), F.col("f").alias("at"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2")]).alias("line"))
    return v.unionByName(f).orderBy("part", "at").select("line")
