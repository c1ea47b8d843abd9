"""Mixing of sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import cut, freed, prepare

#: Sources by code point, null last, weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives each of its documents at most this often.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size): weights share the sum of all sizes; no target is over MOST times its source's size.

    The water level is found in closed form: with sources by how little weight fills them,
    the first k are full and the others share what is left, for the smallest k that leaves
    none of these over its bound. One row per source takes part.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (nth % len(WEIGHTS)) + 1).cast("double"))
    per = per.withColumn("most", (MOST * F.col("source_size")).cast("double")).withColumn("fills", F.col("most") / F.col("weight"))
    order = W.orderBy("fills", F.col("source").asc_nulls_last())
    below = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(W.partitionBy()))
    return per.select("source", "source_size", F.round(F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))), 6).alias("target"))


def _queued(light: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """One row for each group of equal rows of ``light`` (source, size, keys...): how many there are (m), source_size, target, and ``before``, the words of its source's shuffled queue ahead of it.

    The shuffle orders a source's documents by a hash of their id and size; the hash's first
    bits cut each queue into parts of bounded size, so no window holds a whole source, and rows
    that share an id are spread by their sizes. Equal rows are one row from the start.
    """
    n = max(1, light.count())
    bits = min(16, max(4, math.ceil(math.log2(n / 500)) if n > 500 else 4))
    text = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string"))
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null, so that it can be a key
    groups = light.groupBy("source", "size", *keys).agg(F.count("*").alias("m")).withColumns({"place": place, "queue": name})
    groups = groups.withColumn("part", F.shiftright("place", 32 - bits))
    parts = groups.groupBy("queue", "part").agg(F.sum(F.col("m") * F.col("size")).alias("words"))
    parts = parts.select("queue", "part", (F.sum("words").over(W.partitionBy("queue").orderBy("part")) - F.col("words")).alias("ahead"))
    parts = parts.join(targets(light).select(name.alias("queue"), "source_size", "target"), "queue")
    words = F.col("m") * F.col("size")
    within = W.partitionBy("queue", "part").orderBy("place", *keys, "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = groups.join(parts, ["queue", "part"]).withColumn("before", F.col("ahead") + F.sum(words).over(within) - words)
    return rows.drop("part", "ahead")


#: Rows of a group that are told apart at once.
_STEP = 1 << 16


def _each(groups: DataFrame) -> DataFrame:
    """``groups`` with one row for each of their m rows, numbered by nth from 0."""
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _STEP))))
    return blocks.withColumn("nth", F.explode(F.sequence(F.col("block") * _STEP, F.least(F.col("m"), (F.col("block") + 1) * _STEP) - 1))).drop("block")


def _schedule(queued: DataFrame, keys: list[str]) -> DataFrame:
    """(source, size, keys..., nth, copy, words, finish): what the mix takes, by weighted fair queueing.

    Each queue is served over and over, at most MOST times, at a rate of its target, so a
    document's virtual finish time is the words queued up to its end over the target. The
    server is fluid: a document that is being served when the budget is reached, at time 1, is
    two pieces that finish then and later. All pieces are sorted by finish time over ranges;
    the words of the ranges before and a running total inside each range truncate the order
    at the total budget, the sum of the targets in whole words.
    """
    due = F.floor(F.col("target") + 0.5).cast("long")
    with freed(queued.sparkSession):
        budget = queued.select("queue", due.alias("due")).distinct().agg(F.sum("due")).first()[0] or 0
    copies = _each(queued.where("size > 0").withColumn("due", due).where("before < due"))
    copies = copies.withColumn("copy", F.explode(F.array(*[F.lit(c) for c in range(MOST)])))
    copies = copies.withColumn("start", F.col("copy") * F.col("source_size") + F.col("before") + F.col("nth") * F.col("size")).where("start < due")
    first = F.least("size", F.col("due") - F.col("start"))
    ends = lambda words: (F.col("start") + words) / F.col("target")
    two = F.array(F.struct(first.alias("words"), F.least(ends(first), F.lit(1.0)).alias("finish")), F.struct((F.col("size") - first).alias("words"), ends(F.col("size")).alias("finish")))
    pieces = copies.select("queue", "source", "size", "place", *keys, "nth", "copy", F.inline(two)).where("words > 0")
    order = ["finish", "queue", "place", *keys, "size", "nth", "copy"]
    ranged = cut(pieces.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("words").alias("total"))
    sums = sums.select("range", (F.sum("total").over(W.orderBy("range")) - F.col("total")).alias("passed"))  # one row for each range
    upto = F.col("passed") + F.sum("words").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = F.greatest(F.lit(0), F.least("words", F.lit(budget) - upto + F.col("words"))).cast("long")
    return ranged.join(sums, "range").withColumn("words", taken).where("words > 0").select("source", "size", *keys, "nth", "copy", "words", "finish")


def mix_counts(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``; only doc_id, source and text are read.

    ``taken`` is the words of the mix that come from the row, over all its copies. Null texts
    have no words; null sources are one source; rows of equal doc_id, source and size tie and
    are served one after the other. The result depends on the rows only, not on their order. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    light = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
    queued = cut(_queued(light, ["doc_id"], seed))
    every = _each(queued).select("doc_id", "source", "size", "nth", F.lit(0).cast("long").alias("words"), "source_size", "target")
    took = _schedule(queued, ["doc_id"]).select("doc_id", "source", "size", "nth", "words", F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"))
    sums = every.unionByName(took).groupBy("doc_id", "source", "size", "nth").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"))
    return sums.select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each taken copy of a document, with the columns of ``docs``, sorted by virtual finish time across partitions.

    A document that is being served when the budget is reached is cut after a word; n_chars,
    where there is such a column, follows the text. Documents without words are not in the mix,
    nulls and empty tables give nothing. Rows that are equal in all columns are served one
    after the other; rows that share a doc_id, or have none, otherwise stay apart. Columns keep
    their values whatever their names.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    own = "_mix"
    while any(c.startswith(own) for c in names):
        own += "_"
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias(own)
    # two hashes of all columns name a row; texts move once to meet their words and once into order
    named = docs.select(row).select(F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(seed), own).alias("h2"), own)
    light = cut(named.select("h1", "h2", F.col(f"{own}.doc_id").alias("doc_id"), F.col(f"{own}.source").cast("string").alias("source"), n_words(F.col(f"{own}.text").cast("string")).alias("size")))
    keys = ["doc_id", "h1", "h2"]
    served = _schedule(cut(_queued(light, keys, seed)), keys).select("h1", "h2", "size", "nth", "copy", "words", "finish")
    once = named.groupBy("h1", "h2").agg(F.first(own).alias(own))
    rows = once.join(served, ["h1", "h2"]).repartitionByRange("finish", "h1", "h2", "nth", "copy").sortWithinPartitions("finish", "h1", "h2", "nth", "copy")
    text = F.col(f"{own}.text")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(text)
    new = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in names else {})
    return rows.select(*[new.get(c, F.col(f"{own}.`{c}`")).alias(c) for c in names])


#: DuckDB SQL for the rows of ``mix_counts(docs)``. Running totals in order of finish times, cut at the budget, are each queue cut at time 1.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 8) AS BIGINT) AS place FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM s),
f AS (SELECT *, most / weight AS fills FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, weight, most, max(CASE WHEN level <= fills THEN level END) OVER () AS level FROM l),
g AS (SELECT source, source_size, round(least(most, coalesce(level * weight, 0.0)), 6) AS target FROM t),
q AS (SELECT row_number() OVER () AS nr, h.doc_id, h.size, h.place, h.source, g.source_size, g.target, floor(g.target + 0.5) AS due,
             sum(h.size) OVER (PARTITION BY h.source ORDER BY h.place, h.doc_id NULLS FIRST, h.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - h.size AS ahead
      FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, ahead + copy * source_size AS start FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS copy) k WHERE size > 0),
p AS (SELECT nr, copy, least(size, due - start) AS words, least((start + least(size, due - start)) / target, 1.0) AS finish FROM c WHERE start < due
      UNION ALL SELECT nr, copy, start + size - due, (start + size) / target FROM c WHERE start < due AND start + size > due),
o AS (SELECT *, sum(words) OVER (ORDER BY finish, nr, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS passed FROM p),
k AS (SELECT nr, sum(greatest(0, least(words, (SELECT sum(floor(target + 0.5)) FROM g) - passed))) AS taken FROM o GROUP BY nr)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (nr)
"""
