"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .labelled import fitted, remainder, sample
from .shared import prepare

BITS = 17
DIM = 4
#: Lengths in bytes of the n-grams of "<word>"; the word itself is one more subword.
NGRAMS = (3, 4, 5, 6)
#: The classifier is fitted on at most this many labelled rows of each class.
PER_CLASS = 2000
STEPS, RATE, BATCH = 600, 0.5, 64
#: Only subwords of at least so many fitted documents, and of at most this share of either class, get an embedding; the others keep 0.
LEAST_DOCS, MOST_SHARE = 3, 0.3
#: So many neutral subwords join each average, so that a few words alone do not decide.
SHRINK = 50
FOLDS, HELD = 3, 1


def subwords(words: tk.Words, hashes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index into ``pick``) of every subword of the picked words, lower-cased."""
    mask = np.uint64((1 << BITS) - 1)
    s, e = words.starts[pick], words.ends[pick]
    size = e - s + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(pick)), size)
    buckets, owners = [(tk.mix(hashes[pick]) & mask).astype(np.int64)], [np.arange(len(pick))]
    if len(pick) == 0:
        return buckets[0], owners[0]
    source = np.arange(begin[-1]) - begin[owner] + s[owner] - 1
    text = tk._LOWER[words.data[np.clip(source, 0, len(words.data) - 1)]]
    text[begin[:-1]], text[begin[1:] - 1] = ord("<"), ord(">")
    stop = begin[owner + 1]
    a = 0
    while a < len(text):  # segments of whole words share one table of powers
        b = int(begin[max(int(np.searchsorted(begin, a + tk.SEGMENT_BYTES, "right")) - 1, int(owner[a]) + 1)])
        up, down = tk.powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(tk._BYTE_VALUE[text[a:b]] * up[: b - a], out=sums[1:])
        for n in NGRAMS:
            at = np.flatnonzero(np.arange(a, b) + n <= stop[a:b])
            h = tk.mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n * 0x9E3779B9))
            buckets.append((h & mask).astype(np.int64))
            owners.append(owner[a + at])
        a = b
    return np.concatenate(buckets), np.concatenate(owners)


def _bags(batch: pa.RecordBatch):
    """(row, buckets, counts) of each text's subwords."""
    data, offsets = tk.utf8(tk.column(batch, "text"))
    for a, b, piece, at in tk.chunks(data, offsets):
        words = tk.Words(piece, at)
        hashes = words.hashes()
        for i in range(b - a):
            _, pick, times = np.unique(hashes[words.first[i] : words.first[i + 1]], return_index=True, return_counts=True)
            bucket, owner = subwords(words, hashes, pick + words.first[i])
            found, where = np.unique(bucket, return_inverse=True)
            yield a + i, found.astype(np.uint32), np.bincount(where, times[owner], len(found))


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Embeddings and softmax, fitted jointly by Adagrad on mini-batches; returned as what each bucket adds to the class-1 logit, and the bias.

    The classes weigh alike in fitting.
    """
    rng = np.random.default_rng(seed)
    n = 1 << BITS
    if len(set(y.tolist())) < 2:
        return np.zeros(n, np.float32), 40.0 if len(y) and y[0] == 1 else -40.0
    many = np.zeros((2, n), np.int64)
    for (b, _), kind in zip(bags, y, strict=True):
        many[kind, b] += 1
    common = (many > MOST_SHARE * np.bincount(y, minlength=2)[:, None]).all(0)
    known = np.flatnonzero((many.sum(0) >= LEAST_DOCS) & ~common)
    slot = np.full(n, -1, np.int32)
    slot[known] = np.arange(len(known))
    index, shares = [], []
    for b, c in bags:
        kept = slot[b] >= 0
        index.append(slot[b][kept])
        shares.append((c / (c.sum() + SHRINK))[kept].astype(np.float32))
    emb = (rng.uniform(-1, 1, (DIM, len(known))) / DIM).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (2, DIM)), np.zeros(2)
    g_emb, g_out, g_bias = np.full(emb.shape, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    order = rng.permutation(len(bags))
    for step in range(STEPS):
        rows = order.take(np.arange(step * BATCH, step * BATCH + min(BATCH, len(order))), mode="wrap")
        share = np.concatenate([shares[i] for i in rows])
        found, where = np.unique(np.concatenate([index[i] for i in rows]), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), [len(index[i]) for i in rows])
        mean = np.stack([np.bincount(owner, share * emb[d, found][where], len(rows)) for d in range(DIM)], 1)
        logit = mean @ out.T + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p *= weight[rows, None] / len(rows)
        d_mean, d_out, d_bias = p @ out, p.T @ mean, p.sum(0)
        rate = RATE * (1 - step / STEPS)
        for d in range(DIM):
            grad = np.bincount(where, share * d_mean[owner, d], len(found)).astype(np.float32)
            g_emb[d, found] += grad**2
            emb[d, found] -= rate * grad / np.sqrt(g_emb[d, found])
        g_out += d_out**2
        out -= rate * d_out / np.sqrt(g_out)
        g_bias += d_bias**2
        bias -= rate * d_bias / np.sqrt(g_bias)
    w = out[1] - out[0]
    add = np.zeros(n, np.float32)
    add[known] = w @ emb
    return add, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """The model of ``labels`` (doc_id, toxic) on rows outside the held-out fold, from at most ``per_class`` rows of each class."""
    prepare(docs.sparkSession)
    return fitted(sample(docs, labels, label, FOLDS, HELD, per_class), _bags, train)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """``docs`` and the probability of class 1 for each whole text. A null or empty text gets the bias alone."""
    prepare(docs.sparkSession)
    table, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    names, types = docs.columns, dict(docs.dtypes)

    def run(batches):
        add = table.value
        for batch in batches:
            data, offsets = tk.utf8(tk.column(batch, "text").cast(pa.string()))
            score = np.zeros(batch.num_rows)
            for a, b, piece, at in tk.chunks(data, offsets):
                words = tk.Words(piece, at)
                hashes = words.hashes()
                _, pick, kind = np.unique(hashes, return_index=True, return_inverse=True)
                bucket, owner = subwords(words, hashes, pick)
                total, many = np.bincount(owner, add[bucket], len(pick)), np.bincount(owner, minlength=len(pick))
                rows = words.rows
                score[a:b] = np.bincount(rows, total[kind], b - a) / (np.bincount(rows, many[kind], b - a) + SHRINK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(score + bias, -60, 60))))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + f", `{out}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``: the probability of label 1, from the whole text, however long.

    A null or empty text has no subwords and gets the bias alone. Rows with a null doc_id are
    scored too and are not held out; equal texts get equal scores, whatever their ids. Other
    columns are not read. An empty table gives no rows. Without training rows of both classes
    the score is that of the only class, or near 0 without any.
    """
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, each row by itself, with null and repeated ids too; columns as they were. Null and empty texts have the bias alone."""
    score = "_score"
    while score in docs.columns:
        score += "_"
    return scored(docs, fit(docs, labels), score).where(F.col(score) < threshold).select(docs.columns)
