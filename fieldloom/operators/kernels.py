"""Network kernels as matrices (i, j, x), and projections of seed sets through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import blocks
from . import linalg as la
from .graphs import pairwise
from .stage import cut


def vertices_of(a: DataFrame) -> DataFrame:
    return a.select(F.col("i").alias("v")).unionByName(a.select(F.col("j").alias("v"))).distinct()


def random_walk(a: DataFrame, steps: int) -> DataFrame:
    """(A / column sums) ** steps."""
    p = cut(la.column_stochastic(a))
    out = p
    for _ in range(steps - 1):
        out = la.matmul(out, p)
    return out


def random_walk_with_restart(a: DataFrame, alpha: float, terms: int = 60) -> DataFrame:
    """alpha * (I - (1 - alpha) W)^-1 by its power series; the rest is below (1 - alpha) ** terms. alpha 0: each row its share of the total strength."""
    if alpha == 0:
        sums = la.row_sums(a).withColumn("x", F.col("x") / F.sum("x").over(W.partitionBy()))
        return sums.select(F.col("v").alias("i"), "x").crossJoin(vertices_of(a).select(F.col("v").alias("j"))).select("i", "j", "x")
    w = cut(la.scale(la.column_stochastic(a), 1 - alpha))
    eye = cut(la.identity(vertices_of(a)))
    out = eye
    for n in range(terms):  # Horner: I + W (I + W (...))
        out = la.add(eye, la.matmul(w, out))
        if n % 8 == 7:
            out = cut(out)
    return la.scale(out, alpha)


def _dense_rows(m: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, pos): each row as an array over all vertices in order."""
    every = vertices.select(F.col("v").alias("i")).crossJoin(vertices.select(F.col("v").alias("j")))  # as many rows as the matrix has entries
    cells = every.join(m, ["i", "j"], "left").select("i", F.struct("j", F.coalesce("x", F.lit(0.0)).alias("x")).alias("e"))
    return cells.groupBy(F.col("i").alias("v")).agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"]).alias("pos"))


def diffusion_state_distance(a: DataFrame, steps: int) -> DataFrame:
    """(i, j, x), i <> j: L1 distance between rows of I + P + ... + P ** steps, P row-stochastic. With steps < 0, of the limit.

    The limit is that of (I - P + 1 pi)^-1, pi the stationary shares of strength: rows of the
    sums differ by rows of this inverse as the steps go on.
    """
    vertices = cut(vertices_of(a))
    if steps >= 0:
        p, eye = cut(la.row_stochastic(a)), cut(la.identity(vertices))
        c = eye
        for _ in range(steps):
            c = la.add(eye, la.matmul(c, p))
    else:
        at, n = blocks.places(vertices), vertices.count()
        sums = la.row_sums(a)
        share = sums.crossJoin(F.broadcast(sums.agg(F.sum("x").alias("s")))).select(F.col("v").alias("j"), (F.col("x") / F.col("s")).alias("x"))  # one row is sent
        pi = vertices.select(F.col("v").alias("i")).crossJoin(share)  # as many rows as the inverse has entries
        c = blocks.to_entries(blocks.inverse(blocks.from_entries(la.add(la.identity(vertices), la.scale(la.row_stochastic(a), -1.0), pi), at), n), at)
    return pairwise(cut(_dense_rows(c, vertices)), "cityblock")


def heat(a: DataFrame, t: float) -> DataFrame:
    """exp(-t (D - A)), D the column sums, for any t and any weights: in blocks, by scaling and squaring."""
    vertices = cut(vertices_of(a))
    d = la.col_sums(a).select(F.col("v").alias("i"), F.col("v").alias("j"), "x")
    at = blocks.places(vertices)
    step = blocks.from_entries(la.scale(la.add(d, la.scale(a, -1.0)), -t), at)
    return blocks.to_entries(blocks.expm(step, vertices.count()), at)


def interconnectedness(a: DataFrame) -> DataFrame:
    """(A^2 + 2 A)_ij / sqrt(d_i d_j), d the column sums."""
    d = la.col_sums(a)
    end = lambda k: d.select(F.col("v").alias(k), F.col("x").alias(f"d{k}"))
    both = la.add(la.matmul(a, a), la.scale(a, 2.0)).join(end("i"), "i").join(end("j"), "j")
    return both.select("i", "j", (F.col("x") / F.sqrt(F.col("di") * F.col("dj"))).alias("x"))


KERNELS = {"rw": random_walk, "rwr": random_walk_with_restart, "dsd": diffusion_state_distance, "hk": heat, "icn": lambda a, _=None: interconnectedness(a)}


def parse(kid: str) -> tuple[str, float | int | None]:
    """A kernel id's name and parameter."""
    name, _, value = kid.partition("_")
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {kid}; known: {', '.join(KERNELS)}")
    return name, None if name == "icn" else int(value) if name in ("rw", "dsd") else float(value or 0)


def by_name(a: DataFrame, kid: str) -> DataFrame:
    """A kernel by its id: rw_2, rwr_0.3, dsd_3 (dsd_-1 for the limit), hk_0.7, icn."""
    name, value = parse(kid)
    return KERNELS[name](a, value)


# ---- projections -------------------------------------------------------------------------


def project(kernel: DataFrame, seeds: DataFrame, vertices: DataFrame, norm: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(set_id, v, x): the kernel times each seed set's 0/1 vector, over all vertices. ``seeds`` has (set_id, v); all sets share one join. ``targets`` (v) keeps their rows, after norming."""
    sums = kernel.join(seeds.select("set_id", F.col("v").alias("j")).distinct(), "j").groupBy("set_id", F.col("i").alias("v")).agg(F.sum("x").alias("x"))
    every = seeds.select("set_id").distinct().crossJoin(vertices.select("v"))  # the result's own rows
    out = every.join(sums, ["set_id", "v"], "left").select("set_id", "v", F.coalesce("x", F.lit(0.0)).alias("x"))
    out = normalised(out) if norm else out
    return out if targets is None else restricted(out, targets)


def restricted(p: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of some vertices (v)."""
    return p.join(targets.select("v").distinct(), "v", "left_semi").select(p.columns)


def over_random_seeds(kernel: DataFrame, p: DataFrame, samples: DataFrame, vertices: DataFrame, formula: str = "zscore") -> DataFrame:
    """How far projections stand out from those of random seed sets (set_id, v): ``zscore`` or ``onetail``."""
    drawn = cut(project(kernel, samples, vertices))
    if formula == "zscore":
        return zscore(p, statistics(drawn))
    if formula == "onetail":
        return one_tailed(p, drawn)
    raise ValueError(f"unknown formula {formula}; known: zscore, onetail")


def over_random_graphs(p: DataFrame, seeds: DataFrame, stats: DataFrame, variances: bool = False) -> DataFrame:
    """(set_id, v, x): projections less their mean over random graphs, over their spread. ``stats`` is (i, j, mean, std) of the kernel, as rewired_statistics() gives it.

    The spread is the root of the seeds' summed deviations, which is what scores computed so far
    were divided by; with ``variances`` it is the root of summed squares, that of independent entries.
    """
    s = seeds.select("set_id", F.col("v").alias("j")).distinct()
    part = F.col("std") * F.col("std") if variances else F.col("std")
    both = stats.join(s, "j").groupBy("set_id", F.col("i").alias("v")).agg(F.sum("mean").alias("mean"), F.sqrt(F.sum(part)).alias("std"))
    return p.join(both, ["set_id", "v"]).select("set_id", "v", ((F.col("x") - F.col("mean")) / F.when(F.col("std") != 0, F.col("std"))).alias("x"))


def normalised(p: DataFrame) -> DataFrame:
    return p.withColumn("x", F.col("x") / F.sum("x").over(W.partitionBy("set_id")))


def over_seed_size(p: DataFrame, seeds: DataFrame) -> DataFrame:
    n = seeds.select("set_id", "v").distinct().groupBy("set_id").agg(F.count("*").alias("n"))
    return p.join(n, "set_id").select("set_id", "v", (F.col("x") / F.col("n")).alias("x"))


def over_degree(p: DataFrame, a: DataFrame) -> DataFrame:
    return p.join(la.row_sums(a).withColumnRenamed("x", "d"), "v").select("set_id", "v", (F.col("x") / F.col("d")).alias("x"))


def statistics(samples: DataFrame) -> DataFrame:
    """(v, mean, std): over sets, std of the population."""
    return samples.groupBy("v").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def zscore(p: DataFrame, stats: DataFrame) -> DataFrame:
    return p.join(stats, "v").select("set_id", "v", ((F.col("x") - F.col("mean")) / F.when(F.col("std") != 0, F.col("std"))).alias("x"))


def one_tailed(p: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of random seed sets whose projection a node's exceeds."""
    both = p.join(samples.select("v", F.col("x").alias("s")), "v")
    return both.groupBy("set_id", "v").agg(F.avg((F.col("x") > F.col("s")).cast("double")).alias("x"))


def ranking(p: DataFrame, ascending: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """(set_id, v, rank) from 1, among ``candidates`` (v) if given; ties by vertex."""
    p = p if candidates is None else restricted(p, candidates)
    order = F.col("x").asc() if ascending else F.col("x").desc()
    return p.select("set_id", "v", F.row_number().over(W.partitionBy("set_id").orderBy(order, "v")).cast("long").alias("rank"))


def average_projection(kernel: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean of the kernel over sources x targets, absent entries counting as zero."""
    n = sources.select("v").distinct().agg(F.count("*").alias("ns")).crossJoin(targets.select("v").distinct().agg(F.count("*").alias("nt")))
    part = kernel.join(sources.select(F.col("v").alias("j")).distinct(), "j", "left_semi").join(targets.select(F.col("v").alias("i")).distinct(), "i", "left_semi")
    return part.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("s")).crossJoin(n).select((F.col("s") / (F.col("ns") * F.col("nt"))).alias("x"))


def _rewired(edges: DataFrame, samples: int, swaps: int, seed: int, configuration: bool) -> DataFrame:
    """(sample, i, j): the entries that are 1 in each random graph's matrix, one task for each sample; a vertex that its graph leaves without links has none."""
    import numpy as np
    import pandas as pd

    pairs = edges.where("src < dst").select("src", "dst")
    every = edges.sparkSession.range(samples).withColumnRenamed("id", "sample").crossJoin(pairs)

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        part = part.sort_values(["src", "dst"])
        ids = np.unique(part[["src", "dst"]].to_numpy())
        e = np.searchsorted(ids, part[["src", "dst"]].to_numpy())
        if configuration:
            stubs = rng.permutation(e.ravel()).reshape(-1, 2)
            e = stubs[stubs[:, 0] != stubs[:, 1]]
        else:
            there = {tuple(sorted(x)) for x in e.tolist()}
            for _ in range(swaps):
                p, q = rng.integers(0, len(e), 2)
                (a, b), (c, d) = e[p], e[q]
                if len({a, b, c, d}) == 4 and tuple(sorted((a, d))) not in there and tuple(sorted((c, b))) not in there:
                    there -= {tuple(sorted((a, b))), tuple(sorted((c, d)))}
                    there |= {tuple(sorted((a, d))), tuple(sorted((c, b)))}
                    e[p], e[q] = (a, d), (c, b)
        e = ids[np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)]
        return pd.DataFrame({"sample": key[0], "i": e[:, 0], "j": e[:, 1]})

    return every.groupBy("sample").applyInPandas(one, "sample long, i long, j long")


def rewired_statistics(edges: DataFrame, samples: int, swaps: int, kernel, seed: int = 0, configuration: bool = False) -> DataFrame:
    """(i, j, mean, std): the numpy ``kernel(adjacency)`` over random graphs with the same degrees, one task for each sample.

    Graphs come from double edge swaps, or, with ``configuration``, from joining stubs at random
    (loops and repeated edges dropped). std is that of a sample. A kernel that needs the whole
    matrix limits a graph to what a task holds; rewired_interconnectedness() has no such limit.
    """
    import numpy as np
    import pandas as pd

    ids = _ends(edges)
    links = _rewired(edges, samples, swaps, seed, configuration)
    alone = edges.sparkSession.range(samples).withColumnRenamed("id", "sample").crossJoin(ids.select(F.col("v").alias("i"), F.col("v").alias("j"), F.lit(0.0).alias("x")))
    rows = links.withColumn("x", F.lit(1.0)).unionByName(alone)

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(part["i"])
        adj = np.zeros((len(ids), len(ids)))
        adj[np.searchsorted(ids, part["i"]), np.searchsorted(ids, part["j"])] = part["x"]
        k = kernel(adj)
        i, j = np.meshgrid(ids, ids, indexing="ij")
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": np.nan_to_num(k).ravel()})

    cells = rows.groupBy("sample").applyInPandas(one, "i long, j long, x double")
    return cells.groupBy("i", "j").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def _ends(edges: DataFrame) -> DataFrame:
    pairs = edges.where("src < dst")
    return pairs.select(F.col("src").alias("v")).unionByName(pairs.select(F.col("dst").alias("v"))).distinct()


#: Vertices on either side of a tile of rewired_interconnectedness().
TILE = 1024


def rewired_interconnectedness(edges: DataFrame, samples: int, swaps: int, seed: int = 0, configuration: bool = False) -> DataFrame:
    """rewired_statistics() of (A^2 + 2 A) / sqrt(d d'), d being degrees and at least 1, for graphs whose matrix no task could hold.

    One task rewires each sample's links. The kernel's entries that are not zero come from a join
    of the links with themselves; only they are shuffled, to tiles of TILE vertices by TILE, and a
    task computes them and fills its tile's zeros in a few rows at a time.
    """
    import numpy as np
    import pyarrow as pa

    ids = cut(_ends(edges))
    links = cut(_rewired(edges, samples, swaps, seed, configuration))
    degree = links.groupBy("sample", "i").agg(F.count("*").alias("d"))
    twice = links.select("sample", "i", F.col("j").alias("m")).join(links.select("sample", F.col("i").alias("m"), "j"), ["sample", "m"])
    paths = twice.groupBy("sample", "i", "j").agg(F.count("*").alias("x"))
    sums = paths.unionByName(links.select("sample", "i", "j", F.lit(2).cast("long").alias("x"))).groupBy("sample", "i", "j").agg(F.sum("x").alias("x"))
    end = lambda k: degree.select("sample", F.col("i").alias(k), F.sqrt("d").alias(f"d{k}"))
    cells = sums.join(end("i"), ["sample", "i"]).join(end("j"), ["sample", "j"]).select("sample", "i", "j", (F.col("x") / (F.col("di") * F.col("dj"))).alias("x"))

    tiles = max(1, -(-ids.count() // TILE))
    tile = lambda k: F.pmod(F.xxhash64(k), F.lit(tiles)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    # kind 0: a row's vertex, 1: a column's vertex, 2: an entry
    none = lambda kind: F.lit(None).cast(kind)
    lefts = ids.select(tile("v").alias("a"), F.lit(0).alias("kind"), "v").select("a", every.alias("b"), "kind", none("long").alias("sample"), F.col("v").alias("i"), none("long").alias("j"), none("double").alias("x"))
    rights = ids.select(tile("v").alias("b"), F.lit(1).alias("kind"), "v").select(every.alias("a"), "b", "kind", none("long").alias("sample"), none("long").alias("i"), F.col("v").alias("j"), none("double").alias("x"))
    entries = cells.select(tile("i").alias("a"), tile("j").alias("b"), F.lit(2).alias("kind"), "sample", "i", "j", "x")
    dealt = lefts.unionByName(rights).unionByName(entries).repartition(8 * tiles, "a", "b").sortWithinPartitions("a", "b")
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("mean", pa.float64()), ("std", pa.float64())])

    def one(part: pa.Table):
        kind = part["kind"].to_numpy()
        i, j = (part[k].combine_chunks().fill_null(0).to_numpy() for k in ("i", "j"))
        rows, columns, entry = np.sort(i[kind == 0]), np.sort(j[kind == 1]), kind == 2
        cell, at = np.unique(np.searchsorted(rows, i[entry]) * len(columns) + np.searchsorted(columns, j[entry]), return_inverse=True)
        x = np.zeros((samples, len(cell)))
        x[part["sample"].combine_chunks().fill_null(0).to_numpy()[entry], at] = part["x"].combine_chunks().fill_null(0).to_numpy()[entry]
        found = [x.mean(0)]
        if samples > 1:
            found.append(np.sqrt(((x - found[0]) ** 2).sum(0) / (samples - 1)))
        step = max(1, (1 << 17) // (len(columns) + 1))
        ends = pa.array(np.tile(columns, min(step, len(rows))))
        for top in range(0, len(rows) if len(columns) else 0, step):
            n = min(step, len(rows) - top) * len(columns)
            own = slice(*np.searchsorted(cell, [top * len(columns), top * len(columns) + n]))
            filled = []
            for values in found:  # an entry that no graph has is 0 and does not vary
                out = np.zeros(n)
                out[cell[own] - top * len(columns)] = values[own]
                filled.append(pa.array(out))
            if samples == 1:
                filled.append(pa.nulls(n, pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[top : top + step], len(columns))), ends.slice(0, n), *filled], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = table["a"].to_numpy().astype(np.int64) * tiles + table["b"].to_numpy()
            ends = np.flatnonzero(np.diff(keys)) + 1
            for start, end in zip([0, *ends], ends):
                yield from one(table.slice(start, end - start))
            rest = table.slice(ends[-1] if len(ends) else 0)
        if rest is not None and rest.num_rows:
            yield from one(rest)

    return dealt.mapInArrow(run, "i long, j long, mean double, std double")


def seed_vector(vertices: DataFrame, is_seed: Column, norm: bool = False) -> DataFrame:
    """(v, x): 1 for seeds, else 0; divided by the sum if asked."""
    out = vertices.select("v", F.when(is_seed, 1.0).otherwise(0.0).alias("x"))
    return out.withColumn("x", F.col("x") / F.sum("x").over(W.partitionBy())) if norm else out
