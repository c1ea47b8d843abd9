"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, memory-mapped by workers.

Files of a model, in a folder that driver and executors share, one set for each shard:
``words-S`` sorted word hashes, ``count-S`` how often each occurs, ``ahead-S`` how many
different words precede it; ``pairs-S`` sorted word pairs (first id << 32 | second id),
``times-S`` how often each occurs; ``context-S`` per first word: occurrences, and pairs that
occur once, twice, more often. A word's id is its rank in the order of hashes. Counts take 32
bits, or 64 in files where one is larger; more than 2**32 - 2 different words are an error.
"""

from __future__ import annotations

import atexit
import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .labelled import remainder
from .shared import Store, cut, delta, pack, prepare, undelta, unpack

FOLDS, HELD = 7, 2
#: Tokens that a task counts before it passes them on.
FLUSH = 1 << 21
#: Tokens in one shard of the model, about; the number of shards follows the input.
SHARD_TOKENS = 6 << 20
#: The hash that stands for the end of a text.
END = tk.mix(np.array([0xE0D], np.uint64))[0]

_BLOCK = "shard int, keys binary, counts binary"
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of some rows, each row ended by END; and where each row's begin, the total last."""
    words = tk.Words(data, offsets)
    first = words.first + np.arange(len(offsets))
    out = np.full(len(words) + len(offsets) - 1, END, np.uint64)
    out[np.arange(len(words)) + words.rows] = words.hashes()
    return out, first


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class _Counter:
    """Counts of 64-bit keys, passed on as compressed sorted blocks by shard whenever they are many."""

    def __init__(self, shard_of):
        self.shard_of, self.held, self.n = shard_of, [], 0

    def add(self, keys: np.ndarray):
        self.held.append(keys)
        self.n += len(keys)
        return self.flush() if self.n >= FLUSH else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        shard = self.shard_of(keys)
        rows = [(int(s), keys[at], counts[at]) for s in np.unique(shard) for at in (np.flatnonzero(shard == s),)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, *_ in rows], pa.int32()), pa.array([delta(k) for _, k, _ in rows], pa.binary()), pa.array([pack(c.astype("<u8")) for *_, c in rows], pa.binary())], schema=_BLOCK_SCHEMA)


def _shards(batches):
    """(shard, keys, counts) merged from blocks that come in order of shards."""
    shard, keys, counts, n = None, [], [], 0
    for batch in batches:
        for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != shard:
                if shard is not None:
                    yield shard, *_merged(keys, counts)
                shard, keys, counts, n = s, [], [], 0
            keys.append(undelta(k))
            counts.append(unpack(c, "<u8").astype(np.int64))
            n += len(keys[-1])
            if n > 4 * len(keys[0]) and n > FLUSH:
                k, c = _merged(keys, counts)
                keys, counts, n = [k], [c], len(k)
    if shard is not None:
        yield shard, *_merged(keys, counts)


@dataclass
class Model:
    """What finds a model's files, and its totals."""

    store: Store
    bits: int  # words are sharded by the first bits of their hash
    first: np.ndarray  # of each word shard: the id of its first word, and their number last
    total: int = 0
    hot: dict = field(default_factory=dict)  # contexts whose pairs are spread over all shards: id -> (occurrences, once, twice, more)
    discount: tuple = ()  # of pairs that occur once, twice, more often
    discount_1: tuple = ()  # the same for words by how many words precede them
    ahead: tuple = ()  # words by how many words precede them: sum, once, twice, more

    @property
    def shards(self) -> int:
        return 1 << self.bits

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def shard_of_word(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def shard_of_pair(self, pairs: np.ndarray) -> np.ndarray:
        """By the first word, so that a context is whole in one shard; pairs of hot contexts by both words."""
        u = (pairs >> np.uint64(32)).astype(np.int64)
        out = np.minimum(np.searchsorted(self.first, u, "right") - 1, self.shards - 1)
        hot = np.isin(u, np.fromiter(self.hot, np.int64, len(self.hot)))
        out[hot] = (tk.mix(pairs[hot]) % np.uint64(self.shards)).astype(np.int64)
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; unknown ones get -1."""
        return self._look(hashes, self.shard_of_word(hashes), "words", lambda s, at: self.first[s] + at)

    def _look(self, keys: np.ndarray, shard: np.ndarray, name: str, found) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for s in np.unique(shard):
            rows = np.flatnonzero(shard == s)
            table = _mapped(self.store.folder, f"{name}-{s}", "<u8")
            at = np.searchsorted(table, keys[rows])
            hit = np.flatnonzero(at < len(table))
            hit = hit[table[at[hit]] == keys[rows[hit]]]
            out[rows[hit]] = found(s, at[hit])
        return out

    def of_words(self, ids: np.ndarray, name: str) -> np.ndarray:
        """What a dense array by word id holds; 0 for unknown words."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, "right") - 1
        for s in np.unique(shard[(ids >= 0) & (ids < self.size)]):
            rows = np.flatnonzero((shard == s) & (ids >= 0) & (ids < self.size))
            out[rows] = _counts(self.store.folder, f"{name}-{s}", int(self.first[s + 1] - self.first[s]))[ids[rows] - self.first[s]]
        return out


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    return Store(folder).map(name, dtype)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit, else in 64."""
    return counts.astype("<u4" if counts.max(initial=0) <= 0xFFFFFFFF else "<u8")


def _counts(folder: str, name: str, n: int) -> np.ndarray:
    """The ``n`` counts that _narrow() gave; the file's size tells their width."""
    raw = _mapped(folder, name, "u1")
    return raw.view(f"<u{len(raw) // n}") if n else np.zeros(0, "<u4")


def _kinds(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's three discounts from the numbers of n-grams that occur 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [c - (c + 1) * y * b / a if a else 0.0 for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(np.clip(x, 0.05 if n1 else 0.0, c)) for c, x in enumerate(d, 1))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").where(remainder(F.col("doc_id"), FOLDS) != HELD).select("text")


def _counted(train: DataFrame, keys_of, shard_of, shards: int) -> DataFrame:
    """Blocks of counted keys, brought together by shard, in order."""

    def run(batches):
        counter = _Counter(shard_of)
        for batch in batches:
            data, offsets = tk.utf8(batch.column(0))
            for _, _, piece, at in tk.chunks(data, offsets):
                if (out := counter.add(keys_of(piece, at))) is not None:
                    yield out
        if (out := counter.flush()) is not None:
            yield out

    return train.mapInArrow(run, _BLOCK).repartition(shards, "shard").sortWithinPartitions("shard")


def fit(docs: DataFrame) -> Model:
    """The model of all texts outside the held-out fold. Each text is its words and one end; pairs begin at a start mark."""
    spark = prepare(docs.sparkSession)
    train = _training(docs)
    rough = max(1, int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // 6)
    bits = max(0, int(np.ceil(np.log2(rough / SHARD_TOKENS)))) if rough > SHARD_TOKENS else 0
    store = Store.new(spark, "lm")
    atexit.register(store.remove)
    bare = Model(store, bits, np.zeros(1, np.int64))

    def words(batches):
        for s, keys, counts in _shards(batches):
            store.write(f"words-{s}", keys.astype("<u8"))
            store.write(f"count-{s}", _narrow(counts))
            top = np.argsort(-counts, kind="stable")[:16]
            yield pa.RecordBatch.from_pydict({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())], "top": [top.tolist()], "times": [counts[top].tolist()]})

    told = _counted(train, lambda d, o: tokens(d, o)[0], bare.shard_of_word, bare.shards).mapInArrow(words, "shard long, n long, total long, top array<long>, times array<long>").collect()
    sizes = np.zeros(bare.shards, np.int64)
    for r in told:
        sizes[r.shard] = r.n
    for s in np.flatnonzero(sizes == 0):
        for name, kind in (("words", "<u8"), ("count", "<u4")):
            store.write(f"{name}-{s}", np.zeros(0, kind))
    first = np.concatenate([[0], np.cumsum(sizes)])
    if first[-1] >= 0xFFFFFFFF:
        raise OverflowError(f"{first[-1]} different words: pairs of ids take 32 bits each")
    model = Model(store, bits, first, sum(r.total for r in told))
    # contexts with more than half a shard's tokens, and the start mark
    hot = {int(first[r.shard] + i): None for r in told for i, c in zip(r.top, r.times, strict=True) if c > model.total / (2 * model.shards)}
    model.hot = hot | {model.size: None}
    spread = spark.sparkContext.broadcast(model)

    def pairs_of(data, offsets):
        m = spread.value
        h, at = tokens(data, offsets)
        known, back = np.unique(h, return_inverse=True)
        ids = m.ids(known).astype(np.uint64)[back]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[at[:-1]] = m.size
        return before << np.uint64(32) | ids

    def pairs(batches):
        m = spread.value
        for s, keys, times in _shards(batches):
            store.write(f"pairs-{s}", keys.astype("<u8"))
            store.write(f"times-{s}", _narrow(times))
            u = (keys >> np.uint64(32)).astype(np.int64)
            a, b = int(m.first[s]), int(m.first[s + 1])
            hot = np.isin(u, np.fromiter(m.hot, np.int64, len(m.hot)))
            at = u[~hot] - a
            context = np.stack([np.bincount(at, times[~hot], b - a)] + [np.bincount(at[x], minlength=b - a) for x in (times[~hot] == 1, times[~hot] == 2, times[~hot] > 2)])
            store.write(f"context-{s}", _narrow(np.ascontiguousarray(context.T)))
            spread_out = [[int(x), int(times[u == x].sum()), *(int(((times == c) if c < 3 else (times > 2))[u == x].sum()) for c in (1, 2, 3))] for x in np.unique(u[hot])]
            yield _told(s, None, None, _kinds(times).tolist(), spread_out)
            second, many = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            target = np.searchsorted(m.first, second.astype(np.int64), "right") - 1
            for t in np.unique(target):
                rows = target == t
                yield _told(int(t), delta(second[rows]), pack(many[rows].astype("<u8")), None, None)

    merged = cut(_counted(train, pairs_of, lambda k: spread.value.shard_of_pair(k), model.shards).mapInArrow(pairs, f"{_BLOCK}, kinds array<long>, hot array<array<long>>"))
    kinds, sums = np.zeros(4, np.int64), {x: np.zeros(4, np.int64) for x in model.hot}
    done = set()
    for r in merged.where("kinds is not null").select("shard", "kinds", "hot").collect():
        kinds += r.kinds
        done.add(r.shard)
        for x, *parts in r.hot:
            sums[x] += parts
    for s in set(range(model.shards)) - done:
        store.write(f"pairs-{s}", np.zeros(0, "<u8"))
        store.write(f"times-{s}", np.zeros(0, "<u4"))
        store.write(f"context-{s}", np.zeros((int(sizes[s]), 4), "<u4"))

    def ahead(batches):
        m = spread.value
        for s, keys, counts in _shards(batches):
            dense = np.zeros(int(m.first[s + 1] - m.first[s]), np.int64)
            dense[keys.astype(np.int64) - m.first[s]] = counts
            store.write(f"ahead-{s}", _narrow(dense))
            yield pa.RecordBatch.from_pydict({"shard": [s], "kinds": [_kinds(dense).tolist()], "sums": [[int(dense.sum()), *(int(x.sum()) for x in (dense == 1, dense == 2, dense > 2))]]})

    rows = merged.where("keys is not null").select("shard", "keys", "counts").repartition(model.shards, "shard").sortWithinPartitions("shard")
    told = rows.mapInArrow(ahead, "shard long, kinds array<long>, sums array<long>").collect()
    for s in set(range(model.shards)) - {r.shard for r in told}:
        store.write(f"ahead-{s}", np.zeros(int(sizes[s]), "<u4"))
    model.hot = {x: tuple(v.tolist()) for x, v in sums.items()}
    model.discount = discounts(*kinds.tolist())
    model.discount_1 = discounts(*np.sum([r.kinds for r in told], 0).tolist()) if told else (0.0, 0.0, 0.0)
    model.ahead = tuple(np.sum([r.sums for r in told], 0).tolist()) if told else (0, 0, 0, 0)
    return model


def _told(shard, keys, counts, kinds, hot) -> pa.RecordBatch:
    kinds_of = {"shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "kinds": pa.list_(pa.int64()), "hot": pa.list_(pa.list_(pa.int64()))}
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, keys, counts, kinds, hot), kinds_of.values(), strict=True)], names=list(kinds_of))


def _less(counts: np.ndarray, d: tuple) -> np.ndarray:
    """Counts less their discounts."""
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


class Scorer:
    """Log10 probabilities under a model whose files this process maps."""

    def __init__(self, model: Model):
        self.m = model
        total, *kinds = model.ahead
        self.even = float(np.dot(kinds, model.discount_1)) / total / (model.size + 1) if total else 1.0 / (model.size + 1)

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Probability of words without context."""
        ahead = self.m.of_words(ids, "ahead")
        return _less(ahead, self.m.discount_1) / max(1, self.m.ahead[0]) + self.even

    def pairs(self, before: np.ndarray, ids: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Probability of words after the words before them; -1 is an unknown word, the model's size the start."""
        m = self.m
        context = np.zeros((len(ids), 4), np.int64)
        shard = np.searchsorted(m.first, before, "right") - 1
        plain = (before >= 0) & (before < m.size)
        for s in np.unique(shard[plain]):
            rows = np.flatnonzero(plain & (shard == s))
            context[rows] = _counts(m.store.folder, f"context-{s}", 4 * int(m.first[s + 1] - m.first[s])).reshape(-1, 4)[before[rows] - m.first[s]]
        for x, sums in m.hot.items():
            context[before == x] = sums
        times = np.zeros(len(ids), np.int64)
        rows = np.flatnonzero((context[:, 0] > 0) & (ids >= 0))
        keys = before[rows].astype(np.uint64) << np.uint64(32) | ids[rows].astype(np.uint64)
        shard = m.shard_of_pair(keys)
        at = m._look(keys, shard, "pairs", lambda s, i: i)
        for s in np.unique(shard[at >= 0]):
            hit = np.flatnonzero((shard == s) & (at >= 0))
            times[rows[hit]] = _counts(m.store.folder, f"times-{s}", len(_mapped(m.store.folder, f"pairs-{s}", "<u8")))[at[hit]]
        seen = np.maximum(context[:, 0], 1)
        back = np.where(context[:, 0] > 0, context[:, 1:] @ np.array(m.discount) / seen, 1.0)
        return _less(times, m.discount) / seen + back * alone

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of some rows."""
        m, n = self.m, len(offsets) - 1
        h, at = tokens(data, offsets)
        rows = np.repeat(np.arange(n), np.diff(at))
        kinds, back = np.unique(h, return_inverse=True)
        kind_ids = m.ids(kinds)
        count = m.of_words(kind_ids, "count")
        base = np.log10((count + 1) / (m.total + m.size + 1))
        alone, ids = self.words(kind_ids)[back], kind_ids[back]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[at[:-1]] = m.size
        key = (before + 1).astype(np.uint64) << np.uint64(32) | (ids + 1).astype(np.uint64)
        _, pick, spread = np.unique(key, return_index=True, return_inverse=True)
        p = self.pairs(before[pick], ids[pick], alone[pick])[spread]
        return np.diff(at), np.bincount(rows, count[back] > 0, n).astype(np.int64), np.bincount(rows, base[back], n), np.bincount(rows, np.log10(p), n)


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``docs``.

    ``score`` is the log10 probability of the whole text and its end; ``base_score`` that of the
    add-one unigram model. A null or empty text is the end alone. Rows with a null doc_id are
    scored but not learned from; each row is scored by itself, repeated ones alike, and a text
    of any length as a whole. Other columns are not read. An empty table gives no rows. Without
    training texts every word is equally likely. The model's files stay in the shared folder until the driver ends.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or fit(docs)
    spread = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(spread.value)
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            parts = [scorer.texts(piece, at) for _, _, piece, at in tk.chunks(data, offsets, 4 << 20)]
            n, known, base, got = (np.concatenate(x) if parts else np.zeros(0) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()), pa.array(got, pa.float64()), pa.array(10 ** (-got / np.maximum(n, 1)), pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
