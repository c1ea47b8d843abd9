"""Where operators cut lineage and keep files that driver and executors both read.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master
is local (tests) a temporary folder of this machine is made and set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Records and bytes in one Arrow batch between the JVM and Python: bounds a worker's memory whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        atexit.register(shutil.rmtree, folder[7:], ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's switch that removes a query's shuffle files when the query ends, not when the driver next collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """Queries planned and run in here leave no shuffle files behind: for results that are stored or collected at once."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read back from the shared folder from now on.

    The shuffles that made them go as soon as the files are complete, so disk holds the kept
    tables and one step's shuffles, not those of every step so far.
    """
    shared_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the switch


class Store:
    """Raw files under a folder that driver and executors share. Local paths are mapped in place; others are fetched first."""

    def __init__(self, folder: str):
        self.folder = folder

    @classmethod
    def new(cls, spark: SparkSession, kind: str) -> Store:
        return cls(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")

    def _where(self, name: str):
        url = urlparse(f"{self.folder}/{name}")
        if url.scheme in ("", "file"):
            return None, url.path
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.folder}/{name}")

    def write(self, name: str, array: np.ndarray) -> None:
        """Put an array there in one step: a task that runs twice leaves the same file."""
        remote, path = self._where(name)
        array = np.ascontiguousarray(array)
        if remote is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(memoryview(array).cast("B") if array.size else b"")
            os.replace(part, path)
        else:
            remote.create_dir(os.path.dirname(path), recursive=True)
            with remote.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as out:
                out.write(memoryview(array).cast("B") if array.size else b"")
            remote.move(part, path)

    def map(self, name: str, dtype) -> np.ndarray:
        """The array, memory-mapped."""
        remote, path = self._where(name)
        if remote is None:
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        with tempfile.NamedTemporaryFile() as copy:  # the mapping outlives the file's name
            with remote.open_input_stream(path) as source:
                shutil.copyfileobj(source, copy)
            copy.flush()
            return np.memmap(copy.name, dtype, "r") if os.path.getsize(copy.name) else np.zeros(0, dtype)

    def remove(self) -> None:
        remote, path = self._where("x")
        if remote is None:
            shutil.rmtree(os.path.dirname(path), ignore_errors=True)
        else:
            remote.delete_dir(os.path.dirname(path))


def pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)


def delta(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, with equal-weight bytes side by side, compressed."""
    d = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zlib.compress(np.ascontiguousarray(d.T), 1)


def undelta(blob: bytes) -> np.ndarray:
    d = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").ravel(), dtype=np.uint64)


# ---- counts of a fixed size ------------------------------------------------------------

SLICES = 64
#: Partial tables that one task merges.
FAN_IN = 64


def sketch(df: DataFrame, keys, bits: int, columns: list[str]) -> np.ndarray:
    """Counts of all ``keys(batch)`` (64-bit hashes) by their low ``bits`` bits, over every row of ``df``.

    The table has 2**bits entries whatever the input, so it may go to the driver and to every
    worker. Each task counts its own rows; partial tables are merged by a tree of tasks that
    read at most FAN_IN slices each, so no task grows with the input.
    """
    size, slices = 1 << bits, min(SLICES, 1 << bits)
    width = size // slices

    def count(batches):
        import zlib as z

        from pyspark import TaskContext

        table, held, n = np.zeros(size, np.uint32), [], 0

        def add():
            low = (np.concatenate(held) & np.uint64(size - 1)).astype(np.int64)
            found, times = np.unique(low, return_counts=True)
            table[found] += times.astype(np.uint32)

        for batch in batches:
            for h in keys(batch):
                held.append(h)
                n += len(h)
                if n >= 1 << 20:
                    add()
                    held, n = [], 0
        if n:
            add()
        part = TaskContext.get().partitionId()
        for i in range(slices):
            piece = table[i * width : (i + 1) * width]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"slice": [i], "part": [part], "counts": [z.compress(piece, 1)]}, schema=_SKETCH)

    parts = df.select(*columns).mapInArrow(count, "slice int, part int, counts binary")
    n = max(1, df.rdd.getNumPartitions())
    while True:
        parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("slice", "part").applyInArrow(_merge, "slice int, part int, counts binary")
        if n <= FAN_IN:
            break
        n = -(-n // FAN_IN)
    total = np.zeros(size, np.uint32)
    with freed(df.sparkSession):
        found = parts.select("*").collect()
    for row in found:
        total[row.slice * width : (row.slice + 1) * width] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return total


_SKETCH = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _merge(table: pa.Table) -> pa.Table:
    total = 0
    for blob in table["counts"].to_pylist():
        total = total + np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pa.Table.from_pydict({"slice": [table["slice"][0].as_py()], "part": [table["part"][0].as_py()], "counts": [zlib.compress(total, 1)]}, schema=_SKETCH)
