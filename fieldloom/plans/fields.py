"""Further queries: weights, ids and vectors, masks, significance of projections, meshes, and solvers that work through integrators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import METRICS, WITH_PARAMETERS, exponential, r6, rotated
from ..operators import graphs, gromov, integrators, kernels, mesh, paths, tasks, transport, trees
from ..operators import linalg as la
from ..operators.stage import cut
from . import queries as q
from . import tables as t
from .queries import _field, _matrix, _sets, query

# ---- weights, ids, vectors ---------------------------------------------------------------------


@query(f"WITH {t.GRID} SELECT src, dst, CAST(2 AS DOUBLE) w FROM ge")
def unit_weights(spark: SparkSession, d: str) -> DataFrame:
    return graphs.unit_weights(mesh.faces_to_edges(t.grid(spark)[1]), 2.0)


@query(f"WITH {t.GRID} SELECT src, dst, round(list_distance(a.pos, b.pos), 6) + 0.0 w FROM ge JOIN pt a ON a.v = src JOIN pt b ON b.v = dst")
def euclidean_weights(spark: SparkSession, d: str) -> DataFrame:
    points, faces = t.grid(spark)
    return graphs.euclidean_weights(mesh.faces_to_edges(faces), points).select("src", "dst", r6(F.col("w")).alias("w"))


@query(f"WITH {t.TRADE}, {t.FIELDS}, c AS (SELECT v, x FROM fd WHERE k = 0) SELECT i src, j dst, a.x w, l.x src_x, r.x dst_x FROM a JOIN c l ON l.v = i JOIN c r ON r.v = j")
def gathered_ends(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the values of a field at both ends."""
    return graphs.gathered(graphs.to_edges(t.trade(spark, d)), t.nation_fields(spark, d).where("k = 0").select("v", "x"))


@query(f"WITH {t.TRADE}, vx AS (SELECT DISTINCT i v FROM a) SELECT v, round((v % 3 = 1)::INTEGER / (SELECT count(*) FILTER (WHERE v % 3 = 1) FROM vx) * 1000, 6) + 0.0 x FROM vx")
def seed_vector(spark: SparkSession, d: str) -> DataFrame:
    v = kernels.vertices_of(t.trade(spark, d))
    return kernels.seed_vector(v, F.col("v") % 3 == 1, norm=True).select("v", r6(F.col("x") * 1000).alias("x"))


@query(f"WITH {t.TRADE}, nm AS (SELECT CAST(n_nationkey AS BIGINT) v, row_number() OVER (ORDER BY n_name) - 1 r FROM nation) SELECT l.r src, o.r dst, a.x w FROM a JOIN nm l ON l.v = i JOIN nm o ON o.v = j")
def remapped_ids(spark: SparkSession, d: str) -> DataFrame:
    """Edges with nations named by the rank of their names."""
    ids = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("old"), (F.row_number().over(W.orderBy("n_name")) - 1).cast("long").alias("new"))
    return graphs.remapped(graphs.to_edges(t.trade(spark, d)), ids)


@query("""WITH c AS (SELECT c_nationkey v, round(avg(c_acctbal) / 1000, 6) x FROM customer GROUP BY 1), s AS (SELECT DISTINCT s_suppkey v FROM supplier),
dv AS (SELECT row_number() OVER (ORDER BY s.v) - 1 "at", s.v, coalesce(c.x, 0.0) x FROM s LEFT JOIN c ON c.v = s.v) SELECT "at", v, x FROM dv""")
def dense_vector(spark: SparkSession, d: str) -> DataFrame:
    """A sparse field as a dense vector over all suppliers in order."""
    values = t.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("v")).agg(F.round(F.avg("c_acctbal") / 1000, 6).alias("x"))
    return graphs.dense_vector(values, t.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("v")))


@query("""SELECT s_name AS name, round(s_acctbal, 6) + 0.0 x FROM supplier""")
def named_vector(spark: SparkSession, d: str) -> DataFrame:
    """A dense vector of balances, back by the names of its places."""
    s = t.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("v"), F.col("s_acctbal").cast("double").alias("x"), "s_name")
    dense = cut(graphs.dense_vector(s.select("v", "x"), s.select("v")))
    names = dense.join(s.select("v", "s_name"), "v").select("at", F.col("s_name").alias("name"))
    return graphs.named_vector(dense.select("at", r6(F.col("x")).alias("x")), names)


@query(f"WITH {t.TRADE}, r AS (SELECT i v, j w, row_number() OVER (PARTITION BY i ORDER BY j) - 1 p, count(*) OVER (PARTITION BY i) n FROM a) SELECT v, CAST((p - v % 4 + n) % n AS INTEGER) nth, w FROM r")
def rotated_lists(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour lists turned by a number that depends on the vertex."""
    lists = graphs.to_adjacency(graphs.to_edges(t.trade(spark, d)))
    return lists.select("v", F.posexplode(rotated(F.col("adj"), F.col("v") % 4)).alias("nth", "w"))


@query(f"""WITH {t.VECTORS}, e AS (SELECT s.v, list_transform(s.pos, lambda y: CASE WHEN y > 0.5 THEN y ELSE 0 END) a, list_transform(u.pos, lambda y: CASE WHEN y > 0.5 THEN y ELSE 0 END) b, s.pos p, u.pos o FROM p s JOIN p u ON u.v = s.v + 1),
z AS (SELECT *, list_zip(a, b) z, list_zip(p, o) y, len(a) n FROM e),
c AS (SELECT *, CAST(len(list_filter(z, lambda g: g[1] <> 0 AND g[2] <> 0)) AS DOUBLE) tt, CAST(len(list_filter(z, lambda g: g[1] <> 0 AND g[2] = 0)) AS DOUBLE) tf, CAST(len(list_filter(z, lambda g: g[1] = 0 AND g[2] <> 0)) AS DOUBLE) ft, CAST(len(list_filter(z, lambda g: g[1] = 0 AND g[2] = 0)) AS DOUBLE) ff FROM z)
SELECT v, round(CASE WHEN 2 * tt + tf + ft > 0 THEN (tf + ft) / (2 * tt + tf + ft) ELSE 0 END, 6) + 0.0 dice, round((2 * (tf + ft) + ff) / (2 * (tf + ft) + tt + ff), 6) + 0.0 kulsinski, round((tf + ft) / n, 6) + 0.0 matching,
round(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)), 6) + 0.0 rogerstanimoto, round((n - tt) / n, 6) + 0.0 russellrao, round(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)), 6) + 0.0 sokalmichener,
round(CASE WHEN tt + 2 * (tf + ft) > 0 THEN 2 * (tf + ft) / (tt + 2 * (tf + ft)) ELSE 0 END, 6) + 0.0 sokalsneath, round(CASE WHEN tf * ft <> 0 THEN 2 * tf * ft / (tt * ff + tf * ft) ELSE 0 END, 6) + 0.0 yule,
round(CASE WHEN tt + tf + ft > 0 THEN (tf + ft + tt - len(list_filter(z, lambda g: g[1] <> 0 AND g[1] = g[2]))) / (tt + tf + ft) ELSE 0 END, 6) + 0.0 jaccard,
round(pow(list_sum(list_transform(list_zip(y, range(n)), lambda g: pow(abs((1 + g[2] % 3) * (g[1][1] - g[1][2])), 3.0))), 1.0 / 3), 6) + 0.0 wminkowski,
round(sqrt(list_sum(list_transform(list_zip(y, range(n)), lambda g: (g[1][1] - g[1][2]) * (g[1][1] - g[1][2]) / (1 + g[2] % 3)))), 6) + 0.0 seuclidean,
round(sqrt(list_sum(list_transform(y, lambda g: 2 * (g[1] - g[2]) * (g[1] - g[2])))), 6) + 0.0 mahalanobis FROM c""")
def metric_columns_truth(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of truth values (components over 0.5), and those with parameters, between each vector and the one with the next id."""
    p = t.vectors(spark, d)
    dims = p.select(F.size("pos").alias("n")).first()["n"]
    both = p.select("v", F.col("pos").alias("p")).join(p.select((F.col("v") - 1).alias("v"), F.col("pos").alias("o")), "v")
    large = lambda c: F.transform(c, lambda x: F.when(x > 0.5, x).otherwise(0.0))
    both = cut(both.select("v", "p", "o", large("p").alias("a"), large("o").alias("b")))
    names = ("dice", "kulsinski", "matching", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath", "yule", "jaccard")
    own = {"wminkowski": WITH_PARAMETERS["wminkowski"]([1.0 + n % 3 for n in range(dims)], 3.0), "seuclidean": WITH_PARAMETERS["seuclidean"]([1.0 + n % 3 for n in range(dims)]), "mahalanobis": WITH_PARAMETERS["mahalanobis"]([[2.0 * (i == j) for j in range(dims)] for i in range(dims)])}
    return both.select("v", *[r6(METRICS[m](F.col("a"), F.col("b"))).alias(m) for m in names], *[r6(f(F.col("p"), F.col("o"))).alias(m) for m, f in own.items()])


_RANGES = f"WITH {t.CLOUD}, u AS (SELECT v, CAST(r.range AS INTEGER) d, pos[r.range + 1] x FROM p CROSS JOIN range(3) r), m AS (SELECT d, min(x) lo, max(x) hi, avg(x) mean FROM u GROUP BY 1)"


@query(f"{_RANGES} SELECT v, d, round((x - (lo + hi) / 2) / (SELECT max(hi - lo) / 2 FROM m), 6) + 0.0 x FROM u JOIN m USING (d)")
def center_scale_half_range(spark: SparkSession, d: str) -> DataFrame:
    return graphs.center_scale(t.cloud(spark, d), "half_range").select("v", "d", r6(F.col("x")).alias("x"))


@query(f"{_RANGES} SELECT v, d, round((x - mean) / (SELECT 10 * max(hi) FROM m), 6) + 0.0 x FROM u JOIN m USING (d)")
def center_scale_tenth_max(spark: SparkSession, d: str) -> DataFrame:
    return graphs.center_scale(t.cloud(spark, d), "tenth_max").select("v", "d", r6(F.col("x")).alias("x"))


@query(f"WITH {t.HISTOGRAMS} SELECT h, a, b, round(x * 1000, 6) + 0.0 x FROM hx WHERE x > 0.02")
def histogram_support(spark: SparkSession, d: str) -> DataFrame:
    return tasks.support(t.balance_histograms(spark, d), 0.02).select("h", "a", "b", r6(F.col("x") * 1000).alias("x"))


@query(f"WITH {t.FIELDS} SELECT k, min(x) least, max(x) most FROM fd GROUP BY 1")
def field_extent(spark: SparkSession, d: str) -> DataFrame:
    return tasks.extent(t.nation_fields(spark, d))


@query(f"WITH {t.FIELDS} SELECT round(avg((l.x - r.x) * (l.x - r.x)), 6) + 0.0 x FROM fd l JOIN fd r ON l.v = r.v WHERE l.k = 0 AND r.k = 1")
def mean_squared_error(spark: SparkSession, d: str) -> DataFrame:
    f = t.nation_fields(spark, d)
    return tasks.mean_squared_error(f.where("k = 0").select("v", "x"), f.where("k = 1").select("v", "x")).select(r6(F.col("x")).alias("x"))


@query("SELECT round(avg(n), 6) + 0.0 x FROM (SELECT l_suppkey, count(DISTINCT l_partkey) n FROM lineitem GROUP BY 1) z")
def nonzero_per_row(spark: SparkSession, d: str) -> DataFrame:
    m = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count("*").cast("double").alias("x"))
    return tasks.nonzero_per_row(m).select(r6(F.col("x")).alias("x"))


@query("SELECT * FROM (VALUES ('rw_2', 'rw', CAST(2 AS DOUBLE)), ('rwr_0.3', 'rwr', 0.3), ('dsd_-1', 'dsd', -1), ('hk_0.7', 'hk', 0.7), ('icn', 'icn', NULL)) k(kid, name, value)")
def kernel_ids(spark: SparkSession, d: str) -> DataFrame:
    """Kernel ids split into names and parameters."""
    rows = [(kid, *kernels.parse(kid)) for kid in ("rw_2", "rwr_0.3", "dsd_-1", "hk_0.7", "icn")]
    return spark.createDataFrame([(k, n, None if v is None else float(v)) for k, n, v in rows], "kid string, name string, value double")


# ---- projections and their significance ------------------------------------------------------------


@query(f"WITH {q._PROJECT} SELECT * FROM (SELECT set_id, v, round(x / sum(x) OVER (PARTITION BY set_id) * 1000, 6) + 0.0 x FROM pj) z WHERE v IN (SELECT v FROM sd WHERE set_id = 3)")
def projection_destinations(spark: SparkSession, d: str) -> DataFrame:
    """Projections normed over all nations, of one region's nations."""
    a, s = t.trade(spark, d), t.region_seeds(spark, d)
    k = kernels.random_walk(a, 2)
    return _sets(kernels.project(k, s, kernels.vertices_of(a), True, s.where("set_id = 3").select("v")))


@query(f"WITH {q._PROJECT} SELECT set_id, v, row_number() OVER (PARTITION BY set_id ORDER BY round(x, 9) DESC, v) rank FROM pj WHERE v % 2 = 0")
def ranking_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Ranks among nations of even number only."""
    _, _, p = q._projected(spark, d)
    return kernels.ranking(p.withColumn("x", F.round("x", 9)), candidates=p.select("v").where("v % 2 = 0"))


_DRAWN = f"{q._PROJECT}, rd AS (SELECT CAST(s.range AS BIGINT) s, v FROM range(10) s CROSS JOIN vx WHERE (v * 7 + s.range * 11) % 5 = 0), rp AS (SELECT s, k2.i v, sum(k2.x) x FROM k2 JOIN rd ON rd.v = k2.j GROUP BY 1, 2), rf AS MATERIALIZED (SELECT s.s, vx.v, coalesce(rp.x, 0) x FROM (SELECT DISTINCT s FROM rd) s CROSS JOIN vx LEFT JOIN rp ON rp.s = s.s AND rp.v = vx.v)"


def _drawn(spark, d):
    """(kernel, projections, ten drawn seed sets, vertices)."""
    a, k, p = q._projected(spark, d)
    v = cut(kernels.vertices_of(a))
    sets = spark.range(10).withColumnRenamed("id", "set_id").crossJoin(v).where("(v * 7 + set_id * 11) % 5 = 0")
    return k, p, cut(sets), v


@query(f"WITH {_DRAWN}, rs AS (SELECT v, avg(x) m, stddev_pop(x) s FROM rf GROUP BY 1) SELECT set_id, v, round((x - m) / s, 5) + 0.0 x FROM pj JOIN rs USING (v)")
def projection_random_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Projections against those of drawn seed sets, as z-scores."""
    k, p, drawn, v = _drawn(spark, d)
    return _sets_5(kernels.over_random_seeds(k, p, drawn, v))


@query(f"WITH {_DRAWN} SELECT set_id, pj.v, round(avg(CASE WHEN round(pj.x, 9) > round(rf.x, 9) THEN 1.0 ELSE 0.0 END), 6) + 0.0 x FROM pj JOIN rf ON rf.v = pj.v GROUP BY 1, 2")
def projection_random_seeds_onetail(spark: SparkSession, d: str) -> DataFrame:
    k, p, drawn, v = _drawn(spark, d)
    nine = lambda f: f.withColumn("x", F.round("x", 9))
    return kernels.one_tailed(nine(p), nine(kernels.project(k, drawn, v))).select("set_id", "v", r6(F.col("x")).alias("x"))


def _sets_5(p: DataFrame) -> DataFrame:
    return p.select("set_id", "v", r6(F.col("x"), 5).alias("x"))


@query(f"WITH {q._PROJECT}, st AS (SELECT set_id, k2.i v, sum(0.5 * k2.x) m, sqrt(sum(0.1 * k2.x + 0.001)) s FROM k2 JOIN sd ON sd.v = k2.j GROUP BY 1, 2) SELECT pj.set_id, pj.v, round((pj.x - m) / s, 5) + 0.0 x FROM pj JOIN st ON st.set_id = pj.set_id AND st.v = pj.v")
def projection_random_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Projections against given means and deviations of the kernel over random graphs."""
    _, k, p = q._projected(spark, d)
    stats = k.select("i", "j", (0.5 * F.col("x")).alias("mean"), (0.1 * F.col("x") + 0.001).alias("std"))
    return _sets_5(kernels.over_random_graphs(p, t.region_seeds(spark, d), stats))


# ---- integrators ------------------------------------------------------------------------------------


@query(f"WITH {q._DISTANCES}, {t.FIELDS} SELECT CAST(i AS BIGINT) v, k, round(sum(exp(-0.05 * d8.x) * fd.x), 6) + 0.0 x FROM d8 JOIN fd ON fd.v = d8.j WHERE j % 3 <> 0 AND i % 3 = 0 GROUP BY 1, 2")
def interpolated_sums(spark: SparkSession, d: str) -> DataFrame:
    """Kernel-weighted sums of known values at unknown nations, not normalised."""
    known = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("v")).where("v % 3 <> 0")
    return _field(tasks.interpolate(integrators.BruteForce(t.trade_lengths(spark, d), exponential(0.05)), t.nation_fields(spark, d), known))


@query(f"WITH {q._DISTANCES}, {t.FIELDS} SELECT i v, round(sum(exp(-0.1 * d8.x) * fd.x), 6) + 0.0 x FROM d8 JOIN fd ON fd.v = d8.j WHERE k = 0 GROUP BY 1")
def hadamard_square_integrate(spark: SparkSession, d: str) -> DataFrame:
    """(K o K) p through an integrator, without its matrix."""
    p = t.nation_fields(spark, d).where("k = 0").select("v", "x")
    out = integrators.square_integrate(integrators.BruteForce(t.trade_lengths(spark, d), exponential(0.05)), p)
    return out.select("v", r6(F.col("x")).alias("x"))


_ARM = ",\n".join(f"z{n} AS MATERIALIZED (SELECT m.i v, k, 0.1 / {n} * sum(z.x) x FROM mx m JOIN z{n - 1} z ON z.v = m.j GROUP BY 1, 2)" for n in range(1, 31))


@query(f"WITH {q._DISTANCES}, {t.FIELDS}, bd AS (SELECT avg(x) b FROM d8 WHERE i <> j), mx AS MATERIALIZED (SELECT i, j FROM d8, bd WHERE x <= b), kn AS (SELECT * FROM fd WHERE v % 3 <> 0),\nz0 AS MATERIALIZED (SELECT CAST(v AS BIGINT) v, k, x FROM kn UNION ALL SELECT DISTINCT CAST(v AS BIGINT), 9, 1.0 FROM kn),\n{_ARM},\nzz AS MATERIALIZED (SELECT v, k, sum(x) x FROM ({' UNION ALL '.join(f'SELECT * FROM z{n}' for n in range(31))}) u GROUP BY 1, 2)\nSELECT l.v, l.k, round(l.x / (r.x + 1e-9), 6) + 0.0 x FROM zz l JOIN zz r ON r.v = l.v WHERE l.k < 9 AND r.k = 9 AND l.v % 3 = 0")
def threshold_exponential(spark: SparkSession, d: str) -> DataFrame:
    """Normalised interpolation by the exponential of the 0/1 matrix of near pairs."""
    dist = cut(paths.all_pairs(t.trade_lengths(spark, d)))
    bound = dist.where("i <> j").agg(F.avg("x")).first()[0]
    known = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("v")).where("v % 3 <> 0")
    return _field(tasks.interpolate_normalised(integrators.threshold_diffusion(dist, 0.1, bound), t.nation_fields(spark, d), known, 1e-9))


@query(f"WITH {q._DISTANCES}, {t.FIELDS}, kn AS (SELECT * FROM fd WHERE v % 3 <> 0), pr AS (SELECT * FROM (VALUES ('exponential', 0.02), ('exponential', 0.1), ('gaussian', 0.001), ('gaussian', 0.01)) g(method, parameter)), kd AS MATERIALIZED (SELECT method, parameter, i, j, CASE method WHEN 'exponential' THEN exp(-parameter * x) ELSE exp(-parameter * x * x) END w FROM d8, pr WHERE i % 3 = 0), ab AS (SELECT method, parameter, i v, k, sum(w * kn.x) / (sum(w) + 1e-9) x FROM kd JOIN kn ON kn.v = kd.j GROUP BY 1, 2, 3, 4), ve AS (SELECT method, parameter, ab.v, sum((ab.x - coalesce(fd.x, 0)) * (ab.x - coalesce(fd.x, 0))) d, sum(ab.x * coalesce(fd.x, 0)) xy, sum(ab.x * ab.x) xx, sum(coalesce(fd.x * fd.x, 0)) yy FROM ab LEFT JOIN fd ON fd.v = ab.v AND fd.k = ab.k GROUP BY 1, 2, 3) SELECT method, CAST(parameter AS DOUBLE) parameter, round(sqrt(sum(d)), 6) + 0.0 frobenius, round(avg(xy / sqrt(xx * yy)), 6) + 0.0 cosine FROM ve GROUP BY 1, 2")
def method_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two families of kernels with two parameters each, on the same distances, against the true fields."""
    f = t.nation_fields(spark, d)
    known = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("v")).where("v % 3 <> 0")
    base = integrators.BruteForce(t.trade_lengths(spark, d), exponential(0.02))
    methods = {("exponential", s): base.with_kernel(exponential(s)) for s in (0.02, 0.1)} | {("gaussian", s): base.with_kernel(lambda x, s=s: F.exp(-s * x * x)) for s in (0.001, 0.01)}
    return tasks.method_grid(methods, f, known).select("method", "parameter", r6(F.col("frobenius")).alias("frobenius"), r6(F.col("cosine")).alias("cosine"))


@query(f"WITH RECURSIVE {t.GRID}, bl(v, n) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT ge.dst, bl.n + 1 FROM bl JOIN ge ON ge.src = bl.v WHERE bl.n < 6), rc(v) AS (SELECT CAST(0 AS BIGINT) UNION SELECT ge.dst FROM rc JOIN ge ON ge.src = rc.v WHERE ge.dst % 5 <> 3 AND ge.dst IN (SELECT v FROM bl)) SELECT v FROM rc")
def shortest_path_ball(spark: SparkSession, d: str) -> DataFrame:
    """What is nearer than 7 steps to a corner of a mesh, over allowed vertices."""
    e = t.grid_edges(spark)
    corner = spark.createDataFrame([(0,)], "v long")
    allowed = e.select(F.col("src").alias("v")).distinct().where("v % 5 <> 3")
    return trees.shortest_path_ball(e, paths.all_pairs(e, corner, 7.0), 0, 7.0, allowed)


# ---- meshes -------------------------------------------------------------------------------------------


@query(f"""WITH {t.GRID}, e AS (SELECT v0, v1, v2, list_transform(list_zip(b.pos, a.pos), lambda z: z[1] - z[2]) e, list_transform(list_zip(c.pos, a.pos), lambda z: z[1] - z[2]) f FROM fc JOIN pt a ON a.v = v0 JOIN pt b ON b.v = v1 JOIN pt c ON c.v = v2),
n AS (SELECT v0, v1, v2, e[2] * f[3] - e[3] * f[2] x, e[3] * f[1] - e[1] * f[3] y, e[1] * f[2] - e[2] * f[1] z FROM e),
s AS (SELECT v, sum(x) x, sum(y) y, sum(z) z FROM (SELECT v0 v, x, y, z FROM n UNION ALL SELECT v1, x, y, z FROM n UNION ALL SELECT v2, x, y, z FROM n) u GROUP BY 1)
SELECT v, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 nx, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 ny, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 nz FROM s""")
def vertex_normals(spark: SparkSession, d: str) -> DataFrame:
    return mesh.vertex_normals(*t.grid(spark)).select("v", *[r6(F.col("normal")[n]).alias(c) for n, c in enumerate(("nx", "ny", "nz"))])


@query(f"WITH {t.GRID}, qd AS (SELECT q v0, q + 1 v1, q + {t.WIDTH} + 1 v2, q + {t.WIDTH} v3 FROM c), z AS (SELECT v0 s, v1 t FROM qd UNION ALL SELECT v1, v2 FROM qd UNION ALL SELECT v2, v3 FROM qd UNION ALL SELECT v3, v0 FROM qd) SELECT DISTINCT src, dst FROM (SELECT s src, t dst FROM z UNION ALL SELECT t, s FROM z) u")
def quad_edges(spark: SparkSession, d: str) -> DataFrame:
    """The sides of a mesh of four-cornered faces, both ways."""
    _, faces = t.grid(spark)
    upper = faces.where("f % 2 = 0").select("f", "v0", "v1", (F.col("v1") + t.WIDTH).alias("v2"), F.col("v2").alias("v3"))
    return mesh.faces_to_edges(upper)


@query("""WITH f AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) prev, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 0 END kind FROM events)
SELECT event_id, CAST(r.range AS INTEGER) nth, round(CASE WHEN r.range = 0 THEN value - prev WHEN kind = r.range - 1 THEN 1.0 ELSE 0.0 END, 6) + 0.0 x FROM f CROSS JOIN range(4) r WHERE prev IS NOT NULL""")
def snapshot_features(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of one vertex: velocity and one-hot type."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    frames = t.table(spark, d, "events").select("event_id", F.array("value").alias("world_pos"), F.lag("value").over(w).alias("prev"), kind.alias("node_type")).where("prev is not null")
    out = mesh.snapshot(frames.withColumn("prev_world_pos", F.array("prev")), 3)
    return out.select("event_id", F.posexplode("features").alias("nth", "x")).select("event_id", "nth", r6(F.col("x")).alias("x"))


@query(f"WITH {t.GRID}, fr AS (SELECT CAST(s.range AS BIGINT) \"t\", v, list_transform(pos, lambda x: x * (1 + s.range)) pos FROM pt CROSS JOIN range(3) s) SELECT a.t, src, dst, round(list_distance(a.pos, b.pos), 6) + 0.0 length FROM ge JOIN fr a ON a.v = src JOIN fr b ON b.v = dst AND b.t = a.t")
def snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of a mesh's edges in three frames."""
    points, faces = t.grid(spark)
    frames = spark.range(3).withColumnRenamed("id", "t").crossJoin(points).select("t", "v", F.transform("pos", lambda x: x * (1 + F.col("t"))).alias("world_pos"))
    return mesh.snapshot_edges(frames, mesh.faces_to_edges(faces), ["t"]).select("t", "src", "dst", r6(F.col("length")).alias("length"))


# ---- transport and Gromov-Wasserstein -------------------------------------------------------------------

_POINTS = f"WITH {t.FIELDS}, np AS (SELECT c.v, c.x a, s.x b FROM fd c JOIN fd s ON s.v = c.v WHERE c.k = 0 AND s.k = 1), co AS MATERIALIZED (SELECT l.v i, r.v j, pow(abs(l.a - r.a), 1.5) + pow(abs(l.b - r.b), 1.5) x FROM np l CROSS JOIN np r), mp AS MATERIALIZED (SELECT v, 1.0 / (SELECT count(*) FROM np) x FROM np), mq AS MATERIALIZED (SELECT * FROM mp),\n"
_POINT_LOG = []
for _n in range(1, 4):
    _u, _v = ("(SELECT v, 0.0 x FROM mp)", "(SELECT v, 0.0 x FROM mq)") if _n == 1 else (f"lu{_n - 1}", f"lv{_n - 1}")
    _POINT_LOG += [
        f"um{_n} AS MATERIALIZED (SELECT co.i, (u.x + w.x - co.x) / 0.5 m FROM co JOIN {_u} u ON u.v = co.i JOIN {_v} w ON w.v = co.j)",
        f"lu{_n} AS MATERIALIZED (SELECT mp.v, 0.5 * (ln(mp.x) - l.l) + u.x x FROM mp JOIN (SELECT i, ln(sum(exp(m - t))) + any_value(t) l FROM (SELECT i, m, max(m) OVER (PARTITION BY i) t FROM um{_n}) z GROUP BY 1) l ON l.i = mp.v JOIN {_u} u ON u.v = mp.v)",
        f"vm{_n} AS MATERIALIZED (SELECT co.j, (u.x + w.x - co.x) / 0.5 m FROM co JOIN lu{_n} u ON u.v = co.i JOIN {_v} w ON w.v = co.j)",
        f"lv{_n} AS MATERIALIZED (SELECT mq.v, 0.5 * (ln(mq.x) - l.l) + w.x x FROM mq JOIN (SELECT j, ln(sum(exp(m - t))) + any_value(t) l FROM (SELECT j, m, max(m) OVER (PARTITION BY j) t FROM vm{_n}) z GROUP BY 1) l ON l.j = mq.v JOIN {_v} w ON w.v = mq.v)",
    ]


@query(_POINTS + ",\n".join(_POINT_LOG) + "\nSELECT round(avg(exp((u.x + w.x - co.x) / 0.5) * co.x) * 1000, 6) + 0.0 x FROM co JOIN lu3 u ON u.v = co.i JOIN lv3 w ON w.v = co.j")
def sinkhorn_power_cost(spark: SparkSession, d: str) -> DataFrame:
    """The mean cost of an entropic plan between nations as points of two balances, |x - y|^1.5, in the log domain."""
    f = t.nation_fields(spark, d)
    points = cut(f.groupBy("v").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("pos")).where("n = 2").select("v", "pos"))
    cost, even = cut(transport.power_cost(points, points, 1.5)), cut(transport.even(points))
    return transport.transport_cost(transport.log_sinkhorn(cost, even, even, 0.5, 3), cost, "mean").select(r6(F.col("x") * 1000).alias("x"))


@query(f"WITH {t.FIELDS}, z AS (SELECT th.v, exp(th.x) / sum(exp(th.x)) OVER () p, g.x g FROM fd th JOIN fd g ON g.v = th.v WHERE th.k = 0 AND g.k = 1) SELECT v, round(p * (g - (SELECT sum(p * g) FROM z)) * 1000, 6) + 0.0 x FROM z")
def softmax_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of a softmax of one field, applied to another."""
    f = t.nation_fields(spark, d)
    one = lambda k: f.where(F.col("k") == k).select("v", "x")
    both = one(0).join(one(1).select("v"), "v", "left_semi")
    return gromov.softmax_gradient(both, one(1)).select("v", r6(F.col("x") * 1000).alias("x"))


@query(f"WITH {t.FIELDS}, z AS (SELECT th.v, th.x th, exp(th.x) / sum(exp(th.x)) OVER () p, 0.1 * ln(abs(g.x) + 1) - 0.2 * (ln(exp(th.x) / sum(exp(th.x)) OVER ()) + 1) g FROM fd th JOIN fd g ON g.v = th.v WHERE th.k = 0 AND g.k = 1), s AS (SELECT v, th, p * (g - (SELECT sum(p * g) FROM z)) d FROM z), c AS (SELECT v, th, d - (SELECT avg(d) FROM s) d FROM s), n AS (SELECT v, th - 0.3 * d / (1e-10 + (SELECT sqrt(sum(d * d)) FROM c)) x FROM c) SELECT v, round(exp(x) / (SELECT sum(exp(x)) FROM n) * 1000, 6) + 0.0 x FROM n")
def mass_update(spark: SparkSession, d: str) -> DataFrame:
    """A step of a node distribution along the gradient of its logits."""
    f = t.nation_fields(spark, d)
    one = lambda k: f.where(F.col("k") == k).select("v", "x")
    theta = cut(one(0).join(one(1).select("v"), "v", "left_semi"))
    p = theta.withColumn("e", F.exp("x")).select("v", (F.col("e") / F.sum("e").over(W.partitionBy())).alias("x"))
    a = one(1).select("v", (F.abs("x") + 1).alias("x"))
    return gromov.update_distribution(theta, cut(p), a, 0.1, 0.3, 0.2)[1].select("v", r6(F.col("x") * 1000).alias("x"))


@query(f"WITH {q._TWO}, kc AS MATERIALIZED (SELECT p.v i, w.v j, coalesce(l.s, 0) + coalesce(r.s, 0) x FROM mp p CROSS JOIN mq w LEFT JOIN (SELECT i v, sum((cs.x * ln(cs.x + 1e-15) - cs.x) * mp.x) s FROM cs JOIN mp ON mp.v = j GROUP BY 1) l ON l.v = p.v LEFT JOIN (SELECT i v, sum(ct.x * mq.x) s FROM ct JOIN mq ON mq.v = j GROUP BY 1) r ON r.v = w.v), {q._OUTER}, sw AS (SELECT y.i, ct.i j, sum(y.x * ln(ct.x + 1e-15)) x FROM (SELECT cs.i, op.j, sum(cs.x * op.x) x FROM cs JOIN op ON op.i = cs.j GROUP BY 1, 2) y JOIN ct ON ct.j = y.j GROUP BY 1, 2) SELECT kc.i, kc.j, round(kc.x - coalesce(sw.x, 0), 6) + 0.0 x FROM kc LEFT JOIN sw ON sw.i = kc.i AND sw.j = kc.j")
def gw_tensor_product_kl(spark: SparkSession, d: str) -> DataFrame:
    """The cost that a plan meets, with the Kullback-Leibler loss."""
    cs, ct, ps, pt = q._two(spark, d)
    return _matrix(gromov.tensor_product(gromov.invariant_cost(cs, ct, ps, pt, "kl_loss"), cs, ct, la.outer(ps, pt), "kl_loss"))


@query(f"WITH {q._TWO}, {q._CONST}, {q._OUTER},\n{q._proximal_sql(2, 2)}\nSELECT i, j, round(x * 1000, 6) + 0.0 x FROM t1p")
def gw_proximal_integrators(spark: SparkSession, d: str) -> DataFrame:
    """Two proximal steps whose costs are only known through integrators."""
    cs, ct, ps, pt = q._two(spark, d)
    return _matrix(gromov.proximal(integrators.Materialised(cs), integrators.Materialised(ct), ps, pt, 0.1, 2, 2)[0], 1000)


@query(f"WITH {q._TWO}, {q._OUTER}, {t.FIELDS} SELECT op.j v, k, round(any_value(m.x) * 0 + 0.6 * sum(op.x * fd.x) / any_value(m.x) + 0.4 * sum(op.x * fd.x * fd.x) / any_value(m.x), 6) + 0.0 x FROM op JOIN fd ON fd.v = op.i JOIN mq m ON m.v = op.j GROUP BY 1, 2")
def gw_average_features(spark: SparkSession, d: str) -> DataFrame:
    """The weighted mean of two graphs' features (a region's fields, and their squares) on the nodes of a third, by given plans."""
    _, _, ps, pt = q._two(spark, d)
    f = t.nation_fields(spark, d)
    both = f.select(F.lit(0).alias("g"), "v", "k", "x").unionByName(f.select(F.lit(1).alias("g"), "v", "k", (F.col("x") * F.col("x")).alias("x")))
    plan = la.outer(ps, pt)
    plans = plan.select(F.lit(0).alias("g"), "i", "j", "x").unionByName(plan.select(F.lit(1).alias("g"), "i", "j", "x"))
    return _field(gromov.average_features(both, plans, pt, {0: 0.6, 1: 0.4}))


@query()
def fgw_barycenter_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the fused barycenter of all regions' graphs with their nations' fields."""
    graphs_, r = q._region_graphs(spark, d), t.region_seeds(spark, d)
    f = t.nation_fields(spark, d).join(r, "v").select(F.col("set_id").alias("g"), "v", "k", "x")
    inside = graphs_.select("g", F.col("i").alias("v")).distinct()
    return _field(gromov.fused_barycenter(graphs_, cut(f.join(inside, ["g", "v"], "left_semi")), 4, 0.5, 2)[1])


@query()
def recursive_multi_partition(spark: SparkSession, d: str) -> DataFrame:
    """Every region's nations split alike over and over, down to parts of three."""
    return gromov.recursive_multi_partition(q._region_graphs(spark, d), 2, 3, 2)


@query()
def recursive_indirect_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of two regions' nations inside the parts that all regions are split into."""
    return gromov.recursive_indirect_matching(q._region_graphs(spark, d), 2, 3, 2, 3, 2)
