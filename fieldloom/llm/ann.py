"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import atexit
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .labelled import lowest
from .shared import Store, cut, freed, prepare

#: Vectors that the tree is fitted on at most, and their bytes in double precision; every vector is then put into a leaf.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
BRANCH = 4
#: Queries that the number of leaf visits is calibrated on, and the recall it must reach there.
CALIBRATION, RECALL = 256, 0.96
#: Leaves for up to a million vectors; more vectors get more leaves, by the square root.
LEAVES, PER_LEAF = 64, 64
#: Rows in one file of a leaf, about, and rows and queries that are scored together.
FILE_ROWS, ROW_BLOCK, QUERY_BLOCK = 1 << 14, 4096, 1024


class Tree:
    """Centres of a hierarchical k-means tree: node i has children ``kids[i]``; leaves are numbered in ``leaf``."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centres, self.kids, members = [sample.mean(0) if len(sample) else None], [[]], [np.arange(len(sample))]
        heap, n = [(-len(sample), 0)], 1
        while heap and n < leaves:
            size, i = heapq.heappop(heap)
            if -size < 2 * BRANCH:
                break
            part = _kmeans(sample[members[i]], min(BRANCH, leaves - n + 1), rng)
            groups = [members[i][part == g] for g in range(part.max() + 1)]
            groups = [g for g in groups if len(g)]
            if len(groups) < 2:  # equal vectors only
                continue
            for g in groups:
                self.centres.append(sample[g].mean(0))
                self.kids.append([])
                members.append(g)
                self.kids[i].append(len(self.kids) - 1)
                heapq.heappush(heap, (-len(g), len(self.kids) - 1))
            n += len(groups) - 1
        self.centres = np.array(self.centres)
        ends = [i for i, k in enumerate(self.kids) if not k]
        self.leaf = {node: k for k, node in enumerate(ends)}

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root down to the nearest centre."""
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            kids = self.kids[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = np.argmin((c**2).sum(1) - 2 * vectors[rows] @ c.T, 1)
            todo += [(k, rows[near == j]) for j, k in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, least: int, counts: np.ndarray, rows: int) -> list[int]:
        """Leaves in the order of a priority queue over centres, by inner product: at least ``least``, and as many as have ``counts`` of ``rows`` together."""
        score = self.centres @ query
        queue, out, held = [(-score[0], 0)], [], 0
        while queue and (len(out) < least or held < rows):
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                out.append(self.leaf[node])
                held += int(counts[out[-1]])
            for k in self.kids[node]:
                heapq.heappush(queue, (-score[k], k))
        return out


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        part = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        centres = np.stack([x[part == g].mean(0) if (part == g).any() else centres[g] for g in range(k)])
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query id, row, score) of each query's k best ids but its own, each by its best row, ties to the smaller id.

    A product of matrices finds who may be in: rows not below the k-th best id. Those are scored
    again one pair at a time, so that equal vectors have equal scores wherever they stand.
    """
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    begins = np.flatnonzero(np.diff(row_ids, prepend=row_ids[:1] - 1)) if len(row_ids) else np.zeros(0, np.int64)
    rough = queries @ rows.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    for i, q in enumerate(query_ids):
        line = np.where(row_ids == q, -np.inf, rough[i])
        each = np.maximum.reduceat(line, begins) if len(begins) < len(line) else line
        floor = np.partition(each, len(each) - k)[len(each) - k] - slack if len(each) > k else -np.inf
        near = np.flatnonzero((line >= floor) & np.isfinite(line))
        score = (rows[near] * queries[i]).sum(1)
        ranked = np.lexsort((row_ids[near], -score))
        _, once = np.unique(row_ids[near][ranked], return_index=True)
        ranked = ranked[np.sort(once)][:k]
        yield q, order[near[ranked]], score[ranked]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())])


def _found(parts: list) -> pa.RecordBatch:
    """(query id, row ids, scores, leaf) of some queries as a batch."""
    cols = [np.concatenate(x) if parts else [] for x in zip(*[(np.full(len(r), q), r, s, np.full(len(r), leaf)) for q, r, s, leaf in parts], strict=True)] if parts else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Nearest:
    """The k best rows of some queries over blocks of rows that come one after the other."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.held: list[list] = [[] for _ in ids]
        self.size = np.zeros(len(ids), np.int64)

    def meet(self, which: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, leaf: int) -> None:
        for a in range(0, len(rows), ROW_BLOCK):
            part, pid = rows[a : a + ROW_BLOCK].astype(np.float64), row_ids[a : a + ROW_BLOCK]
            for n, (_, at, score) in zip(which, best(self.queries[which], self.ids[which], part, pid, self.k), strict=True):
                self.held[n].append((pid[at], score, np.full(len(at), leaf)))
                self.size[n] += len(at)
                if self.size[n] > 64 * self.k:
                    self.held[n] = [self._best(n)]
                    self.size[n] = len(self.held[n][0][0])

    def _best(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, score, leaf = (np.concatenate(x) for x in zip(*self.held[n], strict=True))
        order = np.lexsort((leaf, ids, -score))
        _, once = np.unique(ids[order], return_index=True)
        order = order[np.sort(once)][: self.k]
        return ids[order], score[order], leaf[order]

    def found(self) -> pa.RecordBatch:
        return _found([(q, *self._best(n)) for n, q in enumerate(self.ids) if self.held[n]])


class Leaves:
    """Rows of a leaf in files of the shared folder, about FILE_ROWS in each."""

    def __init__(self, store: Store, kind: np.dtype, files: np.ndarray):
        self.store, self.kind, self.files = store, kind, files

    def read(self, leaf: int, file: int) -> np.ndarray:
        return self.store.map(f"leaf-{leaf}-{file}", self.kind)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the ``k`` nearest found among all other rows.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; where
    there are fewer candidates than k, all are given. Rows with a null id or with vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of
    another length than the most frequent one. Rows that share a vec_id are one candidate, by
    their best score, and one query. Other columns are not read. An empty table gives no rows.

    How: the tree is fitted on at most SAMPLE vectors; every row gets a leaf, and is written to
    one of its leaf's files in the shared folder, so rows move once. On CALIBRATION queries,
    brute force over all files tells in which visit each true neighbour's leaf comes; the
    number of leaf visits is the smallest that reaches ``recall`` there. Tasks hold some
    queries each, visit their leaves' files one after the other and keep k rows of each query,
    so neither a full leaf (equal vectors) nor a leaf that all queries visit makes a large task
    or a large shuffle.
    """
    spark = prepare(vectors.sparkSession)
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    with freed(spark):
        sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dim, total = int(sizes[0]["dim"]), int(sizes[0]["count"])
    base = base.where(F.size("v") == dim)
    hashed = lambda seed: F.xxhash64(F.col("vec_id"), F.lit(seed))
    with freed(spark):
        picked = _matrix(lowest(base, hashed("fit"), total, max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("v").toArrow()["v"], dim)
    leaves = max(1, min(LEAVES * max(1, math.isqrt(total // 1_000_000)), total // PER_LEAF, len(picked) // 8))
    tree = Tree(picked, leaves)
    shared_tree = spark.sparkContext.broadcast(tree)

    def put(batches):
        for batch in batches:
            leaf = shared_tree.value.assign(_matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    placed = base.mapInArrow(put, f"vec_id long, v array<{kind}>, leaf int")
    counts, held = np.zeros(len(tree.leaf), np.int64), np.zeros(len(tree.leaf), np.int64)
    where = cut(placed.groupBy("vec_id", "leaf").agg(F.count("*").alias("n")))
    for r in where.groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one number for each leaf
        counts[r["leaf"]] = r["n"]
    for r in where.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():
        held[r["leaf"]] = r["count"]  # an id counts in one of its leaves, so leaves hold at least so many ids together
    store = Store.new(spark, "ann")
    atexit.register(store.remove)
    kept = Leaves(store, np.dtype([("id", "<i8"), ("v", "<f4" if kind == "float" else "<f8", (dim,))]), np.maximum(1, -(-counts // FILE_ROWS)))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.zeros(table.num_rows, kept.kind)
        rows["id"], rows["v"] = table["vec_id"].to_numpy(), _matrix(table["v"], dim)
        leaf, file = key[0].as_py(), key[1].as_py()
        kept.store.write(f"leaf-{leaf}-{file}", rows)
        return pa.Table.from_pydict({"leaf": [leaf], "file": [file]}, schema=_FILES)

    n_files = F.element_at(F.array(*[F.lit(int(n)) for n in kept.files]), F.col("leaf") + 1)
    # equal rows are one candidate, so those that very many rows repeat are one row here; the others spread over their leaf's files
    spread = placed.dropDuplicates(["vec_id", "v"]).withColumn("file", F.pmod(F.xxhash64("vec_id", "v"), n_files).cast("int"))
    with freed(spark):
        files = spread.groupBy("leaf", "file").applyInArrow(write, "leaf int, file int").collect()  # two numbers for about FILE_ROWS rows
    there = {(r["leaf"], r["file"]) for r in files}
    least = _calibrated(base, spark.createDataFrame(sorted(there), "leaf int, file int"), kept, tree, counts, dim, every, k, recall)
    names = spark.sparkContext.broadcast({leaf: sorted(f for x, f in there if x == leaf) for leaf in {x for x, _ in there}})

    def search(batches):
        ids, rows, n = [], [], 0

        def answer():
            q, m = np.concatenate(ids), np.concatenate(rows)
            visits = np.zeros((len(q), len(counts)), bool)
            for i, x in enumerate(m):
                visits[i, shared_tree.value.visits(x, least, held, k + 1)] = True
            near = Nearest(m, q, k)
            for leaf in np.flatnonzero(visits.any(0)).tolist():
                which = np.flatnonzero(visits[:, leaf])
                for file in names.value.get(leaf, ()):
                    block = kept.read(leaf, file)
                    near.meet(which, block["v"], block["id"], leaf)
            return near.found()

        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                rows.append(_matrix(part.column(1), dim))
                n += part.num_rows
                if n >= QUERY_BLOCK:
                    yield answer()
                    ids, rows, n = [], [], 0
        if n:
            yield answer()

    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, total // every // 32), total // every // (4 * QUERY_BLOCK))
    asked = base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).repartition(tasks)
    found = asked.mapInArrow(search, "query_id long, vec_id long, score double, leaf int")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


_FILES = pa.schema([("leaf", pa.int32()), ("file", pa.int32())])


def _calibrated(base: DataFrame, files: DataFrame, kept: Leaves, tree: Tree, counts: np.ndarray, dim: int, every: int, k: int, recall: float) -> int:
    """The least number of leaf visits that finds this share of the calibration queries' true neighbours."""
    asked = base.where(F.col("vec_id") % every == 0)
    spark = base.sparkSession
    with freed(spark):
        ask = lowest(asked, F.xxhash64(F.col("vec_id"), F.lit("ask")), asked.count(), CALIBRATION).toArrow()
    if not ask.num_rows:
        return 1
    ids, m = ask["vec_id"].to_numpy(), _matrix(ask["v"], dim)
    shared = spark.sparkContext.broadcast((ids, m))

    def brute(batches):
        ids, m = shared.value
        near = Nearest(m, ids, k)
        for batch in batches:
            for leaf, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = kept.read(leaf, file)
                near.meet(np.arange(len(ids)), block["v"], block["id"], leaf)
        yield near.found()

    tasks = max(1, min(int(files.count()), spark.sparkContext.defaultParallelism * 4))
    found = files.repartition(tasks).mapInArrow(brute, "query_id long, vec_id long, score double, leaf int")
    found = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "leaf")).alias("b")).select("query_id", "vec_id", "b.score", "b.leaf")
    with freed(spark):
        true = _ranked(found, k).select("query_id", "leaf").collect()  # k rows for each of CALIBRATION queries
    order = {int(q): {leaf: n for n, leaf in enumerate(tree.visits(x, len(counts), counts, 0), 1)} for q, x in zip(ids, m, strict=True)}
    ranks = np.sort([order[r["query_id"]][r["leaf"]] for r in true])
    return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) if len(ranks) else 1
