"""Exact self-join of documents on the Jaccard similarity of their word n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk
from .components import ceil_div, components
from .shared import cut, prepare, sketch

#: Counts of n-grams by the low bits of their hash: the global rare-first order. Its size is the bound of what is broadcast. A slot counts
#: up to 2**32 - 1 in all; logarithms of the counts make the order, so a frequent n-gram stands out of its slot's others at any size.
ORDER_BITS = 22
#: Hash ranges whose counts make the suffix filter's lower bound of two sets' difference.
RANGES = 32

#: DuckDB SQL for the rows of ``similar_documents(docs, k=3, percent=90)``.
ORACLE = r"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END g
  FROM texts, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) n FROM grams GROUP BY 1),
shared AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
ends AS (SELECT a u, b v FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT v, root FROM reach JOIN ends ON u = doc_id),
parts AS (SELECT doc_id, min(root) component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) n_shingles, coalesce(component_id, doc_id) component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN parts USING (doc_id)"""

_PREFIX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("ranges", pa.list_(pa.int16())), ("prefix", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct n-gram hashes) of each row with words."""
    data, offsets = tk.utf8(tk.column(batch, "text"))
    for a, _, piece, at in tk.chunks(data, offsets):
        words = tk.Words(piece, at)
        hashes, first = words.hashes(), words.first
        for i in np.flatnonzero(np.diff(first)):
            yield a + int(i), np.unique(tk.shingles(hashes[first[i] : first[i + 1]], k))


def _prefixes(docs: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """Per document: set size n, the set's signature (s1, s2), counts by hash range, and its rarest n-grams first."""
    # 1024 steps to each doubling: counts up to 2**63 stay in order, and apart where they differ by a thousandth
    spread = docs.sparkSession.sparkContext.broadcast((1024 * np.log2(order.astype(np.float32) + 1)).astype(np.uint16))
    mask = np.uint64(len(order) - 1)

    def run(batches):
        order = spread.value
        for batch in batches:
            ids = tk.column(batch, "doc_id").to_pylist()
            out = {name: [] for name in _PREFIX.names}
            done = np.zeros(len(ids), bool)
            for i, grams in _sets(batch, k):
                n = len(grams)
                keep = n - -(-percent * n // 100) + 1
                rare = order[(grams & mask).astype(np.int64)]
                if keep < n:  # only the rarest need sorting
                    low = np.partition(rare, keep - 1)[keep - 1]
                    near = np.flatnonzero(rare <= low)
                    first = near[np.lexsort((grams[near], rare[near]))][:keep]
                else:
                    first = np.lexsort((grams, rare))
                done[i] = True
                for name, value in zip(_PREFIX.names, (ids[i], n, int(grams.sum().view(np.int64)), int(tk.mix(grams).sum().view(np.int64)), np.minimum(np.bincount((grams >> np.uint64(59)).astype(np.int64), minlength=RANGES), 32767).astype(np.int16), grams[first].view(np.int64)), strict=True):
                    out[name].append(value)
            for i in np.flatnonzero(~done):
                for name, value in zip(_PREFIX.names, (ids[i], 0, None, None, None, None), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_PREFIX)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, ranges array<smallint>, prefix array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc, grams) of the wanted ids, and of a few more: a fixed-size table of ids' hashes says which texts to read."""

    def keys(batch):
        yield tk.mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    table = docs.sparkSession.sparkContext.broadcast(np.packbits(sketch(wanted, keys, ORDER_BITS, ["doc"]) > 0))

    def run(batches):
        bits = np.unpackbits(table.value).astype(bool)
        for batch in batches:
            ids = tk.column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(bits[(tk.mix(ids.view(np.uint64)) & np.uint64(len(bits) - 1)).astype(np.int64)]))
            ids = tk.column(batch, "doc_id").to_pylist()
            docs, grams = [], []
            for i, found in _sets(batch, k):
                docs.append(ids[i])
                grams.append(found.view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc": docs, "grams": grams}, schema=_SETS)

    return docs.mapInArrow(run, "doc long, grams array<long>")


def _need(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap of sets of these sizes that are similar enough."""
    return ceil_div(F.lit(percent) * (na + nb), 100 + percent)


def _passes(a: str, b: str, percent: int) -> Column:
    """Length filter; index prefix of the shorter side; positional filter at a shared n-gram that both prefixes hold."""
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    short, long_ = F.least(na, nb), F.greatest(na, nb)
    indexed = lambda n, pos: pos <= n - ceil_div(2 * percent * n, 100 + percent)
    return (
        (100 * short >= percent * long_)
        & F.when(na < nb, indexed(na, pa_)).when(nb < na, indexed(nb, pb)).otherwise(indexed(na, pa_) & indexed(nb, pb))
        & (F.least(na - pa_, nb - pb) >= _need(na, nb, percent))
    )


def _verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: suffix filter by counts of hash ranges, then the exact overlap, once per pair.

    Nothing above the joins asks for their partitioning, so Spark may split a pivot that very many pairs name.
    """
    for x in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("ranges").alias(f"r{x}")), x)
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    near = cut(pairs.where(apart <= F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), percent)).select("a", "b"))
    wanted = cut(near.select(F.col("a").alias("doc")).unionByName(near.select(F.col("b").alias("doc"))).distinct())
    sets = _sets_of(docs, wanted, k)
    both = near.join(sets.withColumnsRenamed({"doc": "a", "grams": "ga"}), "a").join(sets.withColumnsRenamed({"doc": "b", "grams": "gb"}), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("ga", "gb")))
    return both.where(100 * F.col("shared") >= percent * (F.size("ga") + F.size("gb") - F.col("shared"))).select("a", "b")


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: components under "Jaccard similarity of word k-gram sets >= percent/100".

    Texts with fewer than k words are one n-gram; null and empty texts have none, link with
    nothing and are their own component. Rows with a null doc_id keep a null component.
    Repeated rows of one doc_id each get that document's row; different texts of one doc_id are
    one node, and links of either are links of both. Texts of any length are taken whole. Only
    doc_id and text are read; other columns do no harm. An empty table gives no rows.

    How: one pass counts every n-gram in a table of fixed size, which gives one global
    rare-first order. The next pass writes each document's prefix (the rarest n-grams that any
    similar document must meet). Documents with equal sets become one representative. Two
    similar representatives share a prefix n-gram, so links are searched per n-gram in two
    rounds: first every document against one pivot, the document that meets the n-gram
    earliest; then, among documents that are still in different components, those outside the
    n-gram's largest component against all others. A pair inside one component can not change
    the result, so large groups of near copies cost one check per member, not one per pair,
    and no link between components is lost.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.where("doc_id is not null")

    def keys(batch):
        for _, grams in _sets(batch, k):
            yield grams

    order = sketch(known, keys, ORDER_BITS, ["text"])
    base = cut(_prefixes(texts, k, percent, order))
    full = base.where("doc_id is not null and n > 0")
    rep = cut(
        full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc"), F.min_by("ranges", "doc_id").alias("ranges"), F.min_by("prefix", "doc_id").alias("prefix"))
    )
    rows = rep.select("doc", F.posexplode("prefix").alias("pos", "gram")).select("gram", "doc", "pos")
    often = cut(rows.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram"))
    met = rows.join(often, "gram", "left_semi").join(rep.select("doc", "n"), "doc").select("gram", "doc", "n", F.col("pos").cast("long").alias("pos"))
    met = cut(met)  # rows of n-grams that several representatives hold in their prefixes
    pivots = cut(met.groupBy("gram").agg(F.min(F.struct("pos", "n", "doc")).alias("pivot")))
    sizes = rep.select("doc", "n", "ranges")
    first = met.join(pivots, "gram").select(F.struct("doc", "n", "pos").alias("x"), F.col("pivot").alias("y")).where("x.doc <> y.doc").where(_passes("x", "y", percent))
    first = first.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    links = cut(_verified(first, sizes, known, k, percent))
    part = cut(components(links))

    held = met.join(part.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
    mixed = held.groupBy("gram", "part").agg(F.count("*").alias("rows")).groupBy("gram").agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = cut(mixed)
    held = cut(held.join(mixed, "gram"))
    x = held.where("part <> main").alias("x")
    y = held.alias("y")
    second = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("y.doc") < F.col("x.doc"))) & _passes("x", "y", percent))
    second = second.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    more = _verified(second, sizes, known, k, percent)
    joined = components(links.unionByName(more)).withColumnRenamed("node", "doc")

    named = rep.select("s1", "s2", "n", "doc").join(joined, "doc", "left").select("s1", "s2", "n", F.coalesce("component", "doc").alias("component"))
    return base.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the smallest doc_id of each component; columns as they were.

    Different texts of one doc_id stay together or go together; of rows with equal doc_id and
    text one stays, chosen by a hash of all columns. Rows with a null doc_id stay, and so do
    null and empty texts. An empty table gives no rows.
    """
    kept = similar_documents(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    here = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row")).join(kept, "doc_id", "left_semi")
    once = here.groupBy("doc_id", "text").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return once.unionByName(docs.where("doc_id is null"))
