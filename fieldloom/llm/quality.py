"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .labelled import fitted, remainder, sample
from .shared import prepare

BITS = 18
#: The classifier is fitted on at most this many labelled rows of each class.
PER_CLASS = 4000
EPOCHS = 4
#: FTRL-proximal: step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.001
#: A document's feature values are SCALE times each n-gram's share of its n-grams.
SCALE = 20.0
FOLDS, HELD = 5, 0

_PUNCT = np.zeros(256, np.uint64)
for _i, _c in enumerate(".,!?:;|-)\"'", 1):
    _PUNCT[ord(_c)] = _i
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every feature: one and two words, and one to three word shapes.

    A shape is a word's length, its last punctuation mark, whether its first two bytes are
    capitals, whether it ends in a digit, and whether it repeats the word before it.
    """
    n, rows, h = len(words), words.rows, words.hashes()
    if n == 0:
        return np.zeros(0, np.int64), rows
    data, s, e = words.data, words.starts, words.ends
    same = np.zeros(n, bool)
    same[1:] = rows[1:] == rows[:-1]
    shape = np.minimum(e - s, 15).astype(np.uint64) | _PUNCT[data[e - 1]] << np.uint64(4)
    shape |= _UPPER[data[s]].astype(np.uint64) << np.uint64(8) | (_UPPER[data[np.minimum(s + 1, e - 1)]] & (e - s > 1)).astype(np.uint64) << np.uint64(9)
    shape |= _DIGIT[data[e - 1]].astype(np.uint64) << np.uint64(10)
    again = np.zeros(n, np.uint64)
    again[1:] = same[1:] & (h[1:] == h[:-1])
    shape |= again << np.uint64(11)
    mask = np.uint64((1 << BITS) - 1)
    out, owner = [tk.mix(h + np.uint64(1)) & mask], [rows]
    two = np.flatnonzero(same)
    out.append(tk.mix(h[two - 1] * np.uint64(0x9E3779B97F4A7C15) + h[two]) & mask)
    owner.append(rows[two])
    gram, nth = shape.copy(), np.arange(n) - words.first[rows]
    for k in range(1, 4):
        at = np.flatnonzero(nth >= k - 1)
        out.append(tk.mix(gram[at] + np.uint64(k << 60)) & mask)
        owner.append(rows[at])
        gram[1:] = gram[:-1] << np.uint64(12) | shape[1:]
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


class Ftrl:
    """FTRL-proximal for logistic loss on sparse rows (slots, values)."""

    def __init__(self, size: int):
        self.z, self.n, self.bias, self.bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, slots: np.ndarray, values: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ values + self.bias, -35, 35)))
        slope = (p - y) * weight
        g = slope * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g
        self.bias_n += slope * slope
        self.bias -= slope * 0.3 / np.sqrt(1 + self.bias_n)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights by slot, and the bias, from rows of (slots, counts). Both classes weigh alike."""
    model = Ftrl(1 << BITS)
    if len(set(y.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), 40.0 if len(y) == 0 or y[0] == 1 else -40.0
    weight = {c: 0.5 / (y == c).mean() for c in (0, 1)}
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            slots, counts = rows[i]
            model.update(slots.astype(np.int64), SCALE * counts / max(1, counts.sum()), float(y[i]), weight[int(y[i])])
    return model.weights().astype(np.float32), float(model.bias)


def _rows(batch: pa.RecordBatch):
    data, offsets = tk.utf8(tk.column(batch, "text"))
    for a, b, piece, at in tk.chunks(data, offsets):
        slot, row = features(tk.Words(piece, at))
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, *np.unique(slot[order[cut[i] : cut[i + 1]]], return_counts=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """The model of ``labels`` (doc_id, quality) on rows outside the held-out fold, from at most ``per_class`` rows of each class."""
    prepare(docs.sparkSession)
    return fitted(sample(docs, labels, label, FOLDS, HELD, per_class), _rows, train)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``: the probability of label 1, from the whole text.

    A null or empty text has no n-grams and gets the bias alone. Rows with a null doc_id are
    scored too and are not held out; repeated rows score alike. Other columns are not read. An
    empty table gives no rows. Without training rows of both classes the score is that
    of the only class, or near 1 without any.
    """
    spark = prepare(docs.sparkSession)
    weights, bias = fit(docs, labels)
    table = spark.sparkContext.broadcast(weights)

    def run(batches):
        w = table.value
        for batch in batches:
            data, offsets = tk.utf8(tk.column(batch, "text"))
            score = np.zeros(batch.num_rows)
            for a, b, piece, at in tk.chunks(data, offsets):
                slot, row = features(tk.Words(piece, at))
                score[a:b] = SCALE * np.bincount(row, w[slot], b - a) / np.maximum(1, np.bincount(row, minlength=b - a))
            yield pa.RecordBatch.from_arrays([tk.column(batch, "doc_id"), pa.array(1 / (1 + np.exp(-np.clip(score + bias, -60, 60))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
