"""Removal of passages that occur again: sliding runs of sentences, matched over the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .shared import cut, prepare

#: A run is at least so many sentences and words.
SENTENCES, WORDS = 3, 20
#: Sentences of up to so many words are never cut.
ORDINARY = 16
#: Longer ones are cut: of each SPAN words in a row inside them at least one ends a piece, the one with the least hash, the first of
#: equals. So pieces of a passage that stands in two places are the same but near its ends, wherever it begins: a stretch of
#: ORDINARY words without a mark is long in both places, and words at least SPAN - 1 from its ends are cut in both or in neither.
#: A passage without marks holds a common run from 49 words on: a cut in the first 2 * SPAN - 1, at most max(3 * SPAN, WORDS - 1 + SPAN)
#: words of run, and SPAN - 1 more. With marks the bound is max(3 * ORDINARY, WORDS - 1 + ORDINARY) + 2 * ORDINARY - 1 words, for
#: three sentences of just ORDINARY words between two halves; the shorter the sentences, the sooner three whole ones of WORDS words fit in.
SPAN = 8

#: A run has less sentences and words than this. Line breaks cut it further, into at most ORDINARY times as many.
MOST = 1 << 10
#: Where a run stands: its first sentence times LENGTHS, plus how many sentences it has.
LENGTHS = MOST * ORDINARY * 2

_RUNS = pa.schema([("run", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])


def _bare(stop: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """First words of each ``size`` words of a row that hold no stop."""
    if len(stop) < size:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(stop)])
    return np.flatnonzero((sums[size:] == sums[:-size]) & (row[: len(row) - size + 1] == row[size - 1 :]))


def _cuts(hashes: np.ndarray, stop: np.ndarray, row: np.ndarray) -> np.ndarray:
    """``stop`` and, in each SPAN words of a stretch of ORDINARY or more words without a stop, the word with the least hash."""
    long = _bare(stop, row, ORDINARY)
    if not len(long):
        return stop
    inside = np.zeros(len(stop) + 1, np.int64)
    np.add.at(inside, long, 1)
    np.add.at(inside, long + ORDINARY, -1)
    at = _bare(stop, row, SPAN)
    at = at[np.cumsum(inside)[at] > 0]
    out = stop.copy()
    out[at + np.lib.stride_tricks.sliding_window_view(hashes, SPAN)[at].argmin(1)] = True
    return out


class Sentences:
    """Sentences of some rows: ``edges`` (first word of each, and the number of words last) and ``first`` (first sentence of each row, and the total last).

    ``kinds`` has two choices of the edges: by words alone, which are the same however a passage
    is broken into lines, and with line breaks, which lets a run begin and end with a line.
    """

    def __init__(self, words: tk.Words, hashes: np.ndarray):
        n = len(words)
        last = words.data[words.ends - 1] if n else np.zeros(0, np.uint8)
        stop = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        line = np.zeros(n, bool)
        line[:-1] = breaks[words.starts[1:]] > breaks[words.ends[:-1]]
        heads = words.first[:-1][words.first[:-1] < n]
        opens = []
        for ends in (_cuts(hashes, stop, words.rows), _cuts(hashes, stop | line, words.rows)):
            begin = np.zeros(n, bool)
            begin[1:] = ends[:-1]
            begin[heads] = True
            opens.append(begin)
        at = np.flatnonzero(opens[0] | opens[1])
        self.edges = np.append(at, n)
        self.first = np.searchsorted(at, words.first)
        self.kinds = [np.append(np.flatnonzero(begin[at]), len(at)) for begin in opens]

    def runs(self, sentences: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """All shortest runs of enough sentences and words of one kind, from each sentence on and up to each sentence: first sentences and stops."""
        both = []
        for kind in self.kinds:
            e, first = self.edges[kind], np.searchsorted(kind, self.first)
            row_stop = np.repeat(first[1:], np.diff(first))
            row_first = np.repeat(first[:-1], np.diff(first))
            u = np.arange(len(e) - 1)
            ahead = np.maximum(u + sentences, np.searchsorted(e, e[:-1] + words, "left"))
            back = np.minimum(u + 1 - sentences, np.searchsorted(e, e[1:] - words, "right") - 1)
            forward, backward = ahead <= row_stop, back >= row_first
            a = np.concatenate([u[forward], back[backward]])
            b = np.concatenate([ahead[forward], u[backward] + 1])
            both.append(kind[a] * len(self.edges) + kind[b])
        both = np.unique(np.concatenate(both))
        return both // len(self.edges), both % len(self.edges)


def _first_in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each run, in order, is the first of its kind in its row."""
    _, once = np.unique(tk.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out = np.zeros(len(h), bool)
    out[once] = True
    return out


def _runs(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """(run, doc_id, at): each document's first occurrence of each of its runs."""

    def run(batches):
        for batch in batches:
            ids = tk.column(batch, "doc_id").to_numpy(zero_copy_only=False)
            data, offsets = tk.utf8(tk.column(batch, "text"))
            for a, _, piece, at in tk.chunks(data, offsets):
                w = tk.Words(piece, at)
                hashes = w.hashes()
                s = Sentences(w, hashes)
                u, v = s.runs(sentences, words)
                row = np.searchsorted(s.first, u, "right") - 1
                h = tk.runs(hashes, s.edges[u], s.edges[v])
                first = _first_in_row(h, row)
                u, v, row, h = u[first], v[first], row[first], h[first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[a + row], pa.int64()), pa.array((u - s.first[row]) * LENGTHS + (v - u))], schema=_RUNS)

    return docs.mapInArrow(run, "run long, doc_id long, at long")


def repeated_runs(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, first, stop (sentence numbers in the document): runs that a document with a smaller doc_id holds too.

    The smallest doc_id of each run is found with a partial minimum per task before the
    shuffle. The join back is of rows with a cut table, on the run, so Spark may split a run
    that very many documents hold.
    """
    prepare(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if max(sentences, words) >= MOST:
        raise ValueError(f"runs have less than {MOST} sentences and words")
    rows = _runs(known, sentences, words)
    origins = cut(rows.groupBy("run").agg(F.min("doc_id").alias("origin"), F.count("*").alias("times")).where("times > 1").select("run", "origin"))
    later = rows.join(origins, "run").where("doc_id <> origin").select("doc_id", "at").distinct()
    first = F.floor(F.col("at") / LENGTHS).cast("int")
    return later.select("doc_id", first.alias("first"), (first + F.pmod("at", F.lit(LENGTHS))).cast("int").alias("stop"))


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, counts: bool = False) -> DataFrame:
    """``docs`` without the sentences that a repeated_runs() row covers; n_chars, where there is such a column, follows the text.

    A sentence ends after a word that ends in . ! or ?, or at a line break; a sentence of more
    than ORDINARY words is taken as pieces, cut at words chosen by their content. Every passage
    of 49 words without marks that stands in two places loses at least a run, and so does every
    passage of sentences that holds SENTENCES whole ones with WORDS words together; what stays
    of it are its first and last incomplete pieces. Runs are compared word by word, A-Z in lower case. The first occurrence stays, in the smallest doc_id and there at the smallest place.
    Null texts stay null and documents without a repeated run stay as they are. Rows with a null
    doc_id lose only what they repeat themselves; rows that share a doc_id count as one
    document. An empty table gives an empty table. ``counts`` adds n_sentences and n_removed, in
    place of columns of the input with these names.
    """
    if counts:
        docs = docs.drop("n_sentences", "n_removed")
    names = docs.columns
    mark = "_covered"
    while mark in names:
        mark += "_"
    covered = repeated_runs(docs, sentences, words).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "stop"))).alias(mark))
    key = "_key"
    while key in names:
        key += "_"
    df = docs.withColumn(key, F.col("doc_id").cast("long")).join(covered.withColumnRenamed("doc_id", key), key, "left").drop(key).select(*names, F.col(f"{mark}.first").alias(mark), F.col(f"{mark}.stop").alias(f"{mark}_to"))

    def run(batches):
        for batch in batches:
            text = tk.column(batch, "text").cast(pa.string())
            first, stop = batch.column(len(names)), batch.column(len(names) + 1)
            new, total, removed = text.to_pylist(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            data, offsets = tk.utf8(text)
            for a, b, piece, at in tk.chunks(data, offsets):
                w = tk.Words(piece, at)
                hashes = w.hashes()
                s = Sentences(w, hashes)
                u, v = s.runs(sentences, words)
                row = np.searchsorted(s.first, u, "right") - 1
                own = ~_first_in_row(tk.runs(hashes, s.edges[u], s.edges[v]), row)
                starts, stops = [u[own]], [v[own]]  # runs that the document itself holds before
                for i in np.flatnonzero(np.asarray(first.slice(a, b - a).is_valid())).tolist():
                    starts.append(np.minimum(np.array(first[a + i].as_py(), np.int64) + s.first[i], s.first[i + 1]))
                    stops.append(np.minimum(np.array(stop[a + i].as_py(), np.int64) + s.first[i], s.first[i + 1]))
                n = len(s.edges) - 1
                cover = np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(stops), minlength=n + 1)
                gone = np.cumsum(cover)[:n] > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                total[a:b], removed[a:b] = np.diff(s.first), np.diff(sums[s.first])
                begins = np.append(w.starts[s.edges[:-1]], len(piece))
                ends = np.minimum(begins[1:], at[1:][np.repeat(np.arange(b - a), np.diff(s.first))])
                for i in np.flatnonzero(removed[a:b]).tolist():
                    keep = np.ones(at[i + 1] - at[i], bool)
                    for g in range(s.first[i], s.first[i + 1]):
                        if gone[g]:
                            keep[begins[g] - at[i] : ends[g] - at[i]] = False
                    new[a + i] = piece[at[i] : at[i + 1]][keep].tobytes().decode("utf-8")
            touched = np.flatnonzero(removed)
            columns = list(batch.columns[: len(names)])
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names and len(touched):
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                for i in map(int, touched):
                    old[i] = len(new[i]) if new[i] is not None else None
                columns[k] = pa.array(old, columns[k].type)
            extra = [pa.array(total), pa.array(removed)] if counts else []
            yield pa.RecordBatch.from_arrays(columns + extra, names=[*names, *(["n_sentences", "n_removed"] if counts else [])])

    types = dict(docs.dtypes) | {"text": "string"}
    return df.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + (", n_sentences long, n_removed long" if counts else ""))
