"""Dense matrices as square blocks (bi, bj, block): products join blocks, not entries, and numpy does the arithmetic inside tasks.

A block is the bytes of SIZE x SIZE doubles; blocks of zeros are absent. Rows and columns are
places 0..n-1 that ``places`` gives to vertices, so matrices over the same places multiply.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import dense
from .stage import cut

#: Rows and columns of a block. A block takes 512 KB, and no task holds more than HELD of them and what one batch brings.
SIZE, HELD = 256, 64

_BLOCK = "bi int, bj int, block binary"
_SCHEMA = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("block", pa.binary())])


def places(vertices: DataFrame) -> DataFrame:
    """(v, at): the rank of each vertex, from 0. Vertices are sorted over ranges; only the ranges' sizes meet in one task."""
    ranged = cut(vertices.select("v").distinct().repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("v")) - 1
    return cut(ranged.join(before, "part").select("v", (F.col("before") + rank).alias("at")))


def _rows(blocks: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    cols = zip(*blocks, strict=True) if blocks else ([], [], [])
    bi, bj, x = cols
    return pa.RecordBatch.from_arrays([pa.array(bi, pa.int32()), pa.array(bj, pa.int32()), pa.array([np.ascontiguousarray(b).tobytes() for b in x], pa.binary())], schema=_SCHEMA)


def _array(block: bytes) -> np.ndarray:
    return np.frombuffer(block).reshape(SIZE, SIZE)


def _bounded(df: DataFrame) -> DataFrame:
    """Few rows in an Arrow batch, as each holds a block or two."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return df


def from_entries(matrix: DataFrame, at: DataFrame) -> DataFrame:
    """Blocks of (i, j, x); entries that occur again add up, those of unknown vertices are left out."""
    end = lambda k: at.select(F.col("v").alias(k), F.col("at").alias(f"a{k}"))
    rows = matrix.join(end("i"), "i").join(end("j"), "j")
    rows = rows.select((F.col("ai") / SIZE).cast("int").alias("bi"), (F.col("aj") / SIZE).cast("int").alias("bj"), (F.col("ai") % SIZE).cast("int").alias("r"), (F.col("aj") % SIZE).cast("int").alias("c"), "x")

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros((SIZE, SIZE))
        np.add.at(out, (table["r"].to_numpy(), table["c"].to_numpy()), table["x"].to_numpy())
        return pa.Table.from_batches([_rows([(key[0].as_py(), key[1].as_py(), out)])])

    return rows.groupBy("bi", "bj").applyInArrow(fill, _BLOCK)


def to_entries(blocks: DataFrame, at: DataFrame) -> DataFrame:
    """(i, j, x) of the non-zero entries."""

    def run(batches):
        for batch in batches:
            for bi, bj, block in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                x = _array(block)
                r, c = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(bi * SIZE + r, pa.int64()), pa.array(bj * SIZE + c, pa.int64()), pa.array(x[r, c])], names=["ai", "aj", "x"])

    rows = _bounded(blocks).mapInArrow(run, "ai long, aj long, x double")
    end = lambda k: at.select(F.col("v").alias(k), F.col("at").alias(f"a{k}"))
    return rows.join(end("i"), "ai").join(end("j"), "aj").select("i", "j", "x")


def _summed(parts: DataFrame) -> DataFrame:
    """Blocks of one place added up, one after the other."""

    def run(batches):
        here, total = None, None
        for batch in batches:
            for bi, bj, block in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                if (bi, bj) != here:
                    if here is not None:
                        yield _rows([(*here, total)])
                    here, total = (bi, bj), np.zeros((SIZE, SIZE))
                total = total + _array(block)
        if here is not None:
            yield _rows([(*here, total)])

    return _bounded(parts).repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, _BLOCK)


def add(*terms: tuple[DataFrame, float]) -> DataFrame:
    """The sum of blocks times factors."""

    def times(factor: float):
        def run(batches):
            for batch in batches:
                yield _rows([(bi, bj, factor * _array(b)) for bi, bj, b in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True)])

        return run

    out = None
    for blocks, factor in terms:
        part = _bounded(blocks).mapInArrow(times(factor), _BLOCK) if factor != 1 else blocks
        out = part if out is None else out.unionByName(part)
    return _summed(out) if len(terms) > 1 else out


def multiply(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """factor * A B: blocks join on the inner index; each task adds up the products of one place before they move."""
    both = a.select("bi", F.col("bj").alias("m"), F.col("block").alias("x")).join(b.select(F.col("bi").alias("m"), "bj", F.col("block").alias("y")), "m").select("bi", "bj", "x", "y")

    def run(batches):
        held: dict = {}
        for batch in batches:
            for bi, bj, x, y in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                product = factor * (_array(x) @ _array(y))
                held[bi, bj] = held[bi, bj] + product if (bi, bj) in held else product
                if len(held) > HELD:
                    yield _rows([(*k, v) for k, v in held.items()])
                    held = {}
        if held:
            yield _rows([(*k, v) for k, v in held.items()])

    return _summed(_bounded(both).mapInArrow(run, _BLOCK))


def transpose(a: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield _rows([(bj, bi, _array(b).T) for bi, bj, b in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True)])

    return _bounded(a).mapInArrow(run, _BLOCK)


def identity(spark, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                x = np.zeros((SIZE, SIZE))
                here = np.arange(min(SIZE, n - b * SIZE))
                x[here, here] = 1.0
                yield _rows([(b, b, x)])

    return spark.range(-(-n // SIZE)).mapInArrow(run, _BLOCK)


def norms(a: DataFrame) -> tuple[float, float]:
    """The largest sum of absolute values of a column, and of a row; two numbers."""

    def run(batches):
        for batch in batches:
            for bi, bj, block in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                x = np.abs(_array(block))
                for kind, b, sums in ((0, bj, x.sum(0)), (1, bi, x.sum(1))):
                    yield pa.RecordBatch.from_pydict({"kind": [kind] * SIZE, "at": (b * SIZE + np.arange(SIZE)).tolist(), "s": sums.tolist()})

    sums = _bounded(a).mapInArrow(run, "kind long, at long, s double").groupBy("kind", "at").agg(F.sum("s").alias("s")).groupBy("kind").agg(F.max("s").alias("s")).collect()
    found = {r["kind"]: r["s"] for r in sums}
    return found.get(0, 0.0), found.get(1, 0.0)


def _alone(a: DataFrame, n: int, f) -> DataFrame:
    """``f`` of a matrix of one block, in one task."""

    def run(batches):
        for batch in batches:
            for block in batch.column(2).to_pylist():
                x = np.zeros((SIZE, SIZE))
                x[:n, :n] = f(_array(block)[:n, :n])
                yield _rows([(0, 0, x)])

    return _bounded(a).mapInArrow(run, _BLOCK)


def expm(a: DataFrame, n: int) -> DataFrame:
    """The matrix exponential for any norm: A / 2^s with a norm of at most 1/4 through 10 terms of its series (relative rest below 1e-14), squared s times."""
    spark, eye = a.sparkSession, identity(a.sparkSession, n)
    if n <= SIZE:
        both = add((a, 1.0), (eye, 0.0))  # a matrix of zeros has no blocks
        return _alone(both, n, dense.expm)
    a = cut(a)
    size = min(norms(a))
    squarings = max(0, math.ceil(math.log2(size)) + 2) if size > 0 else 0
    a, out = cut(add((a, 0.5**squarings))), cut(eye)
    for k in range(10, 0, -1):
        out = cut(add((identity(spark, n), 1.0), (multiply(a, out, 1.0 / k), 1.0)))
    for _ in range(squarings):
        out = cut(multiply(out, out))
    return out


def inverse(a: DataFrame, n: int, tolerance: float = 1e-11, rounds: int = 100) -> DataFrame:
    """The inverse by Newton's iteration X (2I - A X), from A' over its norms; one number is collected in each round. Singular matrices raise."""
    spark = a.sparkSession
    if n <= SIZE:
        return _alone(add((a, 1.0), (identity(spark, n), 0.0)), n, np.linalg.inv)
    a = cut(a)
    one, most = norms(a)
    out = cut(add((transpose(a), 1.0 / (one * most))))
    for _ in range(rounds):
        rest = cut(add((identity(spark, n), 1.0), (multiply(a, out), -1.0)))
        gap = max(norms(rest))
        if gap < tolerance:
            return out
        out = cut(add((out, 1.0), (multiply(out, rest), 1.0)))
    raise ArithmeticError(f"no inverse after {rounds} rounds")


def apply(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """``f(x, y)`` of blocks at the same place, for f(0, 0) = 0; absent ones are zeros."""
    both = a.withColumnRenamed("block", "x").join(b.withColumnRenamed("block", "y"), ["bi", "bj"], "full").select("bi", "bj", "x", "y")

    def run(batches):
        zero = np.zeros((SIZE, SIZE))
        for batch in batches:
            yield _rows([(bi, bj, f(zero if x is None else _array(x), zero if y is None else _array(y))) for bi, bj, x, y in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True)])

    return _bounded(both).mapInArrow(run, _BLOCK)
