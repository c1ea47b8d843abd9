"""Graphs as edges(src, dst, w), both directions stored; points as (v, pos ARRAY<DOUBLE>)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .stage import cut

#: Points in one block of a pairwise computation.
BLOCK = 1024
#: Distances given one way round before the same are given the other way round: near enough for files' compression to find them again.
MIRROR = 32


def _pos(table: pa.Table, name: str = "pos") -> np.ndarray:
    column = table[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _by_dimension(part, join=np.add, start: float = 0.0):
    """Distances made dimension by dimension on one tile, so that no array has a third axis."""

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, one = np.full((len(a), len(b)), start), np.empty((len(a), len(b)))
        for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):
            np.subtract(x[:, None], y, out=one)
            part(one)
            join(out, one, out=out)
        return out

    return distance


_squares = _by_dimension(lambda x: np.multiply(x, x, out=x))
_METRIC = {
    "euclidean": lambda a, b: np.sqrt(_squares(a, b)),
    "sqeuclidean": _squares,
    "cityblock": _by_dimension(lambda x: np.abs(x, out=x)),
    "chebyshev": _by_dimension(lambda x: np.abs(x, out=x), np.maximum),
    "cosine": lambda a, b: 1 - a @ b.T / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))),
}


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Rounded with halves away from zero, as SQL does, and never -0.0."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    scaled -= whole
    whole += scaled >= 0.5
    whole -= scaled <= -0.5
    return whole / 10.0**digits + 0.0


def _rounded_squares(a: np.ndarray, b: np.ndarray, digits: int = 9) -> np.ndarray:
    """rounded(_squares(a, b)) by one matrix product; where the product's error could reach a half, by the sum over dimensions."""
    scale, sa, sb = 10.0**digits, (a * a).sum(1), (b * b).sum(1)
    # both sums are within (d + 3) * eps / 2 * (|a| + |b|)^2 of the value, and scaling adds eps / 2 of it: twice that, in units of the last digit
    slack = 4 * (a.shape[1] + 5) * np.finfo(float).eps * scale * (sa.max(initial=0.0) + sb.max(initial=0.0))
    if not slack < 1 / 64:  # nor if it is not a number
        return rounded(_squares(a, b), digits)
    x = a @ b.T
    x *= -2.0
    x += sa[:, None]
    x += sb
    x *= scale
    whole = np.rint(x)
    x -= whole
    i, j = np.nonzero(np.abs(x, out=x) >= 0.5 - slack)
    whole /= scale
    whole += 0.0
    if len(i):
        whole[i, j] = rounded(np.add.accumulate((a[i] - b[j]) ** 2, axis=1)[:, -1], digits)
    return whole


def _rounded_metric(metric: str):
    """The metric's distances between the rows of two arrays, rounded."""
    return _rounded_squares if metric == "sqeuclidean" else lambda a, b, distance=_METRIC[metric]: rounded(distance(a, b))


def distances(pos: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between the rows of one array, as pairwise() gives them."""
    return _rounded_metric(metric)(pos, pos)


def packed(points: DataFrame) -> DataFrame:
    """(b, ids, pos, n): points in blocks of at most BLOCK, their components one after another, kept in few partitions; no point is in two rows."""
    size = BLOCK

    def pack(batches):
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            while rest.num_rows >= size:
                yield row(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and rest.num_rows:
            yield row(rest)

    def row(t: pa.Table) -> pa.RecordBatch:
        ids, pos = t["v"].to_numpy(), _pos(t)
        of = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays([of(ids, pa.int64()), of(pos.ravel(), pa.float64()), pa.array([len(ids)], pa.int32())], names=["ids", "pos", "n"])

    n = points.count()
    parts = max(1, -(-n // size))
    # whole blocks but for one in each partition, with a few partitions for few points, as pairs of partitions are tasks
    dealt = points.select("v", "pos").repartition(max(min(parts, 8), -(-parts // 8)))
    return cut(dealt.mapInArrow(pack, "ids array<long>, pos array<double>, n int").withColumn("b", F.monotonically_increasing_id()))


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of blocks ``left`` with every row of ``right``, a task for each pair of their partitions: tasks read both and nothing is shuffled."""
    return left.hint("shuffle_replicate_nl").crossJoin(right)


def _blockwise(points: DataFrame, metric: str, choose, within: tuple = ()) -> DataFrame:
    """Edges that ``choose(distances, same)`` keeps. Blocks of points meet in tasks that read them from where they are kept, one pair of blocks at a time. With ``within``, only between points that are equal in these columns."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])
    distance = _rounded_metric(metric)

    def tiles(xv, xp, yv, yp):
        step = max(1, (1 << 16) // (len(yv) + 1))
        for at in range(0, len(xv), step):
            d = distance(xp[at : at + step], yp)
            i, j = choose(d, xv[at : at + step, None] == yv[None], yv)
            yield xv[at + i], yv[j], d[i, j]

    if within:
        return _within(points, within, tiles, schema)

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                xv, xp, yv, yp = (batch.column(c)[r].values.to_numpy() for c in range(4))
                for part in tiles(xv, xp.reshape(len(xv), -1), yv, yp.reshape(len(yv), -1)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], schema=schema)

    blocks = packed(points)
    right = blocks.select(F.col("ids").alias("ids2"), F.col("pos").alias("pos2"))
    return met(blocks.select("ids", "pos"), right).mapInArrow(pairs, "src long, dst long, w double")


def _within(points: DataFrame, within: tuple, tiles, schema: pa.Schema) -> DataFrame:
    """One group for each pair of blocks of points that are equal in the columns ``within``; no group holds more than two blocks."""
    n = points.groupBy(*within).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = points.select(*within, "v", "pos", block.alias("a")).select(*within, "v", "pos", "a", every.alias("b"))
    right = points.select(*within, F.col("v").alias("u"), F.col("pos").alias("at"), block.alias("b")).select(*within, "u", "at", "b", every.alias("a"))

    def pairs(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        parts = list(tiles(x["v"].to_numpy(), _pos(x), y["u"].to_numpy(), _pos(y, "at")))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)

    return left.groupBy(*within, "a", "b").cogroup(right.groupBy(*within, "a", "b")).applyInArrow(pairs, "src long, dst long, w double")


def pairwise(points: DataFrame, metric: str = "euclidean", within: tuple = ()) -> DataFrame:
    """All distances (i, j, x), i <> j, rounded to 9 digits; with ``within``, of points that are equal in these columns.

    Without it, each pair of blocks meets once and gives its distances both ways round: up to
    MIRROR of a point's as (i, j), then the same as (j, i), so that stored rows take little more
    than half of a distance's 8 bytes each.
    """
    if within:
        found = _blockwise(points, metric, lambda d, same, ids: np.nonzero(~same), within)
        return found.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x"))
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("x", pa.float64())])
    distance, width = _rounded_metric(metric), MIRROR

    def mirrored(xv, xp, yv, yp, same: bool):
        step = max(1, (1 << 15) // width)
        for left in range(0, len(yv), width):
            ids, pos = yv[left : left + width], yp[left : left + width]
            for top in range(0, min(len(xv), left + len(ids)) if same else len(xv), step):
                v = xv[top : top + step]
                d = distance(xp[top : top + step], pos)
                keep = v[:, None] != ids
                if same:
                    keep &= np.arange(top, top + len(v))[:, None] < np.arange(left, left + len(ids))
                i = np.stack([np.broadcast_to(v[:, None], d.shape), np.broadcast_to(ids, d.shape)], axis=1)
                part = i, i[:, ::-1], np.stack([d, d], axis=1)
                if not keep.all():
                    both = np.stack([keep, keep], axis=1)
                    part = [c[both] for c in part]
                yield [c.ravel() for c in part]

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                xv, xp, yv, yp = (batch.column(c)[r].values.to_numpy() for c in (1, 2, 4, 5))
                same = batch.column(0)[r].as_py() == batch.column(3)[r].as_py()
                for part in mirrored(xv, xp.reshape(len(xv), -1), yv, yp.reshape(len(yv), -1), same):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], schema=schema)

    blocks = packed(points).select("b", "ids", "pos")
    right = blocks.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns])
    return met(blocks, right).where("b <= b2").mapInArrow(pairs, "i long, j long, x double")


def epsilon_graph(points: DataFrame, eps: float, metric: str = "cityblock", inclusive: bool = True) -> DataFrame:
    """Edges between different points at most (or less than) eps apart, weighted by distance; weight 0 is kept.

    In up to CELL_DIMS dimensions, points meet only those of their own and neighbouring cells of
    width eps; beyond that, all pairs of blocks meet.
    """
    first = points.select(F.size("pos").alias("n")).first()
    if first is not None and 0 < first["n"] <= CELL_DIMS and metric in CELL_METRICS and eps > 0:
        return _by_cells(points, eps, metric, inclusive, first["n"])
    return _blockwise(points, metric, lambda d, same, ids: np.nonzero(((d <= eps) if inclusive else (d < eps)) & ~same))


#: Metrics under which points at most eps apart differ by at most eps in each dimension, and the dimensions in which cells pay.
CELL_METRICS, CELL_DIMS = ("euclidean", "cityblock", "chebyshev"), 3


def _by_cells(points: DataFrame, eps: float, metric: str, inclusive: bool, dims: int) -> DataFrame:
    from ..functions.columns import METRICS

    own = [F.floor(F.col("pos")[d] / eps).cast("long") for d in range(dims)]
    right = points.select(F.col("v").alias("dst"), F.col("pos").alias("b"), *[c.alias(f"c{d}") for d, c in enumerate(own)])
    left = points.select(F.col("v").alias("src"), F.col("pos").alias("a"), *[c.alias(f"o{d}") for d, c in enumerate(own)])
    for d in range(dims):
        left = left.withColumn(f"c{d}", F.explode(F.array(*[F.col(f"o{d}") + s for s in (-1, 0, 1)])))
    w = F.round(METRICS[metric](F.col("a"), F.col("b")), 9) + F.lit(0.0)
    pairs = left.join(right, [f"c{d}" for d in range(dims)]).where("src <> dst").select("src", "dst", w.alias("w"))
    return pairs.where(F.col("w") <= eps if inclusive else F.col("w") < eps)


def _nearest(points: DataFrame, k: int, include_self: bool) -> DataFrame:
    """Edges (src, dst, w) to k points of each partition of blocks that are nearest by (rounded distance, id).

    One matrix product gives squares that are surely within ``slack``; only pairs that could be among
    the k nearest by these have their distance made and rounded as pairwise() does.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])

    def choose(a, b, sa, sb, same, worst):
        """(row, column) of the pairs of one strip that may be among their rows' nearest, where ``worst`` is each row's farthest so far."""
        slack = 4 * (a.shape[1] + 5) * np.finfo(float).eps * (sa.max(initial=0.0) + sb.max(initial=0.0))
        if np.isfinite(slack):
            x = a @ b.T
            x *= -2.0
            x += sa[:, None]
            x += sb
        else:
            x, slack = _squares(a, b), 0.0
        if same is not None:
            x[same] = np.nan
        limit = (worst + 2e-9) ** 2 + slack
        many = np.flatnonzero(~np.isfinite(worst))
        if len(many) and k < len(b):
            kth = np.partition(x[many], k - 1, axis=1)[:, k - 1]
            limit[many] = np.where(np.isnan(kth), np.inf, (np.sqrt(np.maximum(kth, 0) + slack) + 2e-9) ** 2 + slack)
        return np.nonzero(x <= limit[:, None])

    def near(xv, xp, yv, yp, w, ids):
        """The k nearest so far (w, ids), a row for each point, with those of another block."""
        sa, sb, step = (xp * xp).sum(1), (yp * yp).sum(1), max(1, (1 << 16) // (len(yv) + 1))
        for top in range(0, len(xv), step):
            own = slice(top, top + step)
            a = xp[own]
            same = None if include_self else xv[own, None] == yv
            i, j = choose(a, yp, sa[own], sb, same if same is not None and same.any() else None, w[own].max(1))
            if not len(i):
                continue
            d = np.concatenate([rounded(np.sqrt(np.add.accumulate((a[i[s : s + 4096]] - yp[j[s : s + 4096]]) ** 2, axis=1)[:, -1])) for s in range(0, len(i), 4096)])
            row, d, v = np.concatenate([np.repeat(np.arange(len(a)), k), i]), np.concatenate([w[own].ravel(), d]), np.concatenate([ids[own].ravel(), yv[j]])
            order = np.lexsort((v, d, row))
            row = row[order]
            kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            w[own], ids[own] = d[kept].reshape(-1, k), v[kept].reshape(-1, k)

    def given(xv, w, ids):
        i, j = np.nonzero(np.isfinite(w))
        return pa.RecordBatch.from_arrays([pa.array(xv[i]), pa.array(ids[i, j]), pa.array(w[i, j])], schema=schema)

    def pairs(batches):
        last, left, w, ids = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                b, (xv, xp, yv, yp) = batch.column(0)[r].as_py(), (batch.column(c)[r].values.to_numpy() for c in range(1, 5))
                if b != last:
                    if last is not None:
                        yield given(left, w, ids)
                    last, left, w, ids = b, xv.copy(), np.full((len(xv), k), np.inf), np.full((len(xv), k), np.iinfo(np.int64).max)
                near(xv, xp.reshape(len(xv), -1), yv, yp.reshape(len(yv), -1), w, ids)
        if last is not None:
            yield given(left, w, ids)

    blocks = packed(points)
    right = blocks.select(F.col("ids").alias("ids2"), F.col("pos").alias("pos2"))
    return met(blocks.select("b", "ids", "pos"), right).mapInArrow(pairs, "src long, dst long, w double")


def knn_graph(points: DataFrame, k: int, metric: str = "euclidean", include_self: bool = False) -> DataFrame:
    """Directed edges to each point's k nearest points by (distance, id). The ranking sees k rows at most of each point and partition of blocks, or of each block."""

    def choose(d, same, ids):
        d = d if include_self else np.where(same, np.inf, d)
        many = min(k, d.shape[1])
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :many]
        i = np.repeat(np.arange(len(d)), many)
        keep = np.isfinite(d[i, order.ravel()])
        return i[keep], order.ravel()[keep]

    near = _nearest(points, k, include_self) if metric == "euclidean" and k > 0 else _blockwise(points, metric, choose)
    rank = F.row_number().over(W.partitionBy("src").orderBy("w", "dst"))
    return near.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, with the smallest weight."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def to_matrix(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("x"))


def to_edges(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("x").alias("w"))


def to_adjacency(edges: DataFrame) -> DataFrame:
    """(v, adj, weights): neighbours in order of id."""
    lists = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("n"))
    return lists.select("v", F.col("n.dst").alias("adj"), F.col("n.w").alias("weights"))


def from_adjacency(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("v").alias("src"), F.inline(F.arrays_zip("adj", "weights"))).withColumnsRenamed({"adj": "dst", "weights": "w"})


def degrees(edges: DataFrame) -> DataFrame:
    """(v, degree, strength)."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices`` (v); ids stay."""
    return edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi").join(vertices.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends renamed by ``ids`` (old, new); edges with an end that has no new name go."""
    end = lambda x: ids.select(F.col("old").alias(x), F.col("new").alias(f"n_{x}"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "w")


def dense_vector(values: DataFrame, vertices: DataFrame, fill: float = 0.0) -> DataFrame:
    """(at, v, x): a value for every vertex (v) by its rank from 0, ``fill`` where ``values`` (v, x) has none."""
    from .blocks import places

    return places(vertices).join(values, "v", "left").select("at", "v", F.coalesce("x", F.lit(float(fill))).alias("x"))


def named_vector(dense: DataFrame, names: DataFrame) -> DataFrame:
    """(name, x): values (at, x) by the names (at, name) of their places."""
    return dense.join(names, "at").select("name", "x")


def gathered(edges: DataFrame, values: DataFrame, name: str = "x") -> DataFrame:
    """Edges with what ``values`` (v, name) holds for their ends, as src_name and dst_name."""
    end = lambda x: values.select(F.col("v").alias(x), F.col(name).alias(f"{x}_{name}"))
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def unit_weights(edges: DataFrame, w: float = 1.0) -> DataFrame:
    return edges.select("src", "dst", F.lit(float(w)).alias("w"))


def euclidean_weights(edges: DataFrame, points: DataFrame) -> DataFrame:
    from ..functions.columns import euclidean

    at = lambda end: points.select(F.col("v").alias(end), F.col("pos").alias(f"p_{end}"))
    return edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", euclidean(F.col("p_src"), F.col("p_dst")).alias("w"))


def center_scale(points: DataFrame, how: str = "max_norm") -> DataFrame:
    """Points about their mean, divided by the largest norm; or about the middle of each axis, by half the largest range; or (x - mean) / (10 * max)."""
    dims = points.select(F.posexplode("pos").alias("d", "x"), "v")
    stats = dims.groupBy("d").agg(F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    mid = {"max_norm": F.col("mean"), "half_range": (F.col("lo") + F.col("hi")) / 2, "tenth_max": F.col("mean")}[how]
    moved = dims.join(F.broadcast(stats), "d").select("v", "d", (F.col("x") - mid).alias("x"))  # one row for each dimension
    sizes = {"max_norm": moved.groupBy("v").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s")).agg(F.max("s").alias("s")), "half_range": stats.agg((F.max(F.col("hi") - F.col("lo")) / 2).alias("s")), "tenth_max": stats.agg((10 * F.max("hi")).alias("s"))}[how]
    return moved.crossJoin(F.broadcast(sizes)).select("v", "d", (F.col("x") / F.when(F.col("s") != 0, F.col("s"))).alias("x"))
