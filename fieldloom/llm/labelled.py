"""Bounded samples of labelled rows, the split by crc32 of the document's id, and fitting in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Store, freed, pack, unpack

#: Bytes of packed rows in one file that a fit keeps in the shared folder.
PIECE_BYTES = 16 << 20
_FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds))


def lowest(rows: DataFrame, key: Column, total: int, most: int) -> DataFrame:
    """The ``most`` rows with the least ``key`` (a 64-bit hash), of ``total``.

    Rows over the hash below which all of these lie, but for a chance under 1e-8, do not take
    part in the ordering, so it sees about ``most`` rows whatever the number of partitions.
    """
    share = (most + 6 * math.sqrt(most) + 20) / max(1, total)
    if share < 1:
        rows = rows.where(key < F.lit(int(share * 2.0**64) - (1 << 63)))
    return rows.orderBy(key, *rows.columns).limit(most)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` training rows of each class, by a hash of the id.

    Rows of ``labels`` with a null id or label, or without a document, are left out; of several
    labels of a document the largest counts, of several documents of one id the least text. At
    most 2 * per_class ids are broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(remainder(F.col("doc_id"), folds) != held).join(texts.select("doc_id"), "doc_id", "left_semi")
    with freed(docs.sparkSession):
        many = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    key = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    picked = [lowest(known.where(f"y = {y}"), key, many.get(y, 0), per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    return texts.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


class Packed(Sequence):
    """Sparse rows (keys, counts) in files that are mapped, each unpacked when it is read."""

    def __init__(self, pieces: list[np.ndarray], places: list[tuple[int, int, int, int]]):
        self.pieces, self.places = pieces, places

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        piece, a, b, c = self.places[i]
        return unpack(self.pieces[piece][a:b], np.uint32), unpack(self.pieces[piece][b:c], np.uint32)


def fitted(rows: DataFrame, sparse: Callable, train: Callable) -> tuple[np.ndarray, float]:
    """``train(rows, labels)`` -> (weights, bias) over sparse(batch) -> (row, keys, counts) of ``rows`` (doc_id, text, y), run in one task of an executor.

    The task keeps the packed rows in files of the shared folder and maps them. The driver gets
    the model alone, however long the texts.
    """
    store = Store.new(rows.sparkSession, "fit")

    def run(batches):
        for batch in batches:
            ids, ys = batch.column(0), batch.column(2)
            got = [(ids[i].as_py(), ys[i].as_py(), pack(k.astype(np.uint32)), pack(c.astype(np.uint32))) for i, k, c in sparse(batch)]
            cols = zip(*got, strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _FEATURES, strict=True)], schema=_FEATURES)

    def fit(batches):
        held, size, pieces, index = [], 0, 0, []

        def put():
            nonlocal held, size, pieces
            store.write(f"rows-{pieces}", np.frombuffer(b"".join(held), np.uint8))
            held, size, pieces = [], 0, pieces + 1

        for batch in batches:
            for i, y, k, c in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                index.append((i, y, pieces, size, size + len(k), size + len(k) + len(c)))
                held += [k, c]
                size += len(k) + len(c)
                if size >= PIECE_BYTES:
                    put()
        if held:
            put()
        index.sort(key=lambda x: x[0])  # ids are distinct: the order of arrival does not matter
        weights, bias = train(Packed([store.map(f"rows-{n}", np.uint8) for n in range(pieces)], [x[2:] for x in index]), np.array([x[1] for x in index], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pack(weights.astype(np.float32))]), pa.array([float(bias)])], names=["weights", "bias"])

    packed = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, keys binary, counts binary").repartition(1)
    with freed(rows.sparkSession):
        model = packed.mapInArrow(fit, "weights binary, bias double").first()
    store.remove()
    if model is None:  # Spark found out that there are no rows
        weights, bias = train(Packed([], []), np.zeros(0, np.int64))
        return weights.astype(np.float32), float(bias)
    return unpack(bytes(model["weights"]), np.float32), float(model["bias"])
