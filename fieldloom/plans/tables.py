"""Graphs, points and fields that queries make of the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import doubles
from ..operators import graphs, mesh
from ..operators.stage import cut


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, x): line items between nations of customers and suppliers, both ways, without a nation's own."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    n = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = n.select(F.col("a").alias("i"), F.col("b").alias("j"), "n").unionByName(n.select(F.col("b").alias("i"), F.col("a").alias("j"), "n"))
    return cut(both.where("i <> j").groupBy("i", "j").agg(F.sum("n").cast("double").alias("x")))


TRADE = """
t AS (SELECT CAST(c_nationkey AS BIGINT) a, CAST(s_nationkey AS BIGINT) b, count(*) n FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
a AS MATERIALIZED (SELECT i, j, CAST(sum(n) AS DOUBLE) x FROM (SELECT a i, b j, n FROM t UNION ALL SELECT b, a, n FROM t) u WHERE i <> j GROUP BY i, j)"""


def trade_lengths(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, w): the trade graph with 1000 / trade as length."""
    return cut(trade(spark, d).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.round(1000.0 / F.col("x"), 9).alias("w")))


LENGTHS = TRADE + ",\ne AS MATERIALIZED (SELECT i src, j dst, round(1000.0 / x, 9) w FROM a)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), doubles(F.col("embedding")).alias("pos"), F.col("label").cast("int").alias("label"))


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """(v, pos): the first three components of each vector."""
    return vectors(spark, d).select("v", F.slice("pos", 1, 3).alias("pos"), "label")


VECTORS = "p AS MATERIALIZED (SELECT vec_id v, CAST(embedding AS DOUBLE[]) pos, CAST(label AS INTEGER) label FROM embeddings)"
CLOUD = "p AS MATERIALIZED (SELECT vec_id v, CAST(embedding[1:3] AS DOUBLE[]) pos, CAST(label AS INTEGER) label FROM embeddings)"

NEIGHBOURS = 10
KNN = VECTORS + f""",
dd AS (SELECT s.v src, t.v dst, round(list_distance(s.pos, t.pos), 9) + 0.0 w FROM p s JOIN p t ON s.v <> t.v),
knn AS MATERIALIZED (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) r FROM dd) q WHERE r <= {NEIGHBOURS}),
mutual AS MATERIALIZED (SELECT k.* FROM knn k SEMI JOIN knn q ON q.src = k.dst AND q.dst = k.src)"""


def knn(spark: SparkSession, d: str) -> DataFrame:
    return graphs.knn_graph(vectors(spark, d), NEIGHBOURS)


WIDTH, HEIGHT = 24, 16


def grid(spark: SparkSession, _d: str = "") -> tuple[DataFrame, DataFrame]:
    return mesh.grid(spark, WIDTH, HEIGHT)


GRID = f"""
v AS (SELECT CAST(range AS BIGINT) v FROM range({WIDTH * HEIGHT})),
pt AS MATERIALIZED (SELECT v, [CAST(v % {WIDTH} AS DOUBLE), CAST(v // {WIDTH} AS DOUBLE), ((v % {WIDTH}) * 7 + (v // {WIDTH}) * 13) % 5 / 10.0] pos FROM v),
c AS (SELECT CAST(range AS BIGINT) c, (range // {WIDTH - 1}) * {WIDTH} + range % {WIDTH - 1} q FROM range({(WIDTH - 1) * (HEIGHT - 1)})),
fc AS MATERIALIZED (SELECT 2 * c f, q v0, q + 1 v1, q + {WIDTH} v2 FROM c UNION ALL SELECT 2 * c + 1, q + 1, q + {WIDTH} + 1, q + {WIDTH} FROM c),
sd AS (SELECT v0 s, v1 t FROM fc UNION ALL SELECT v1, v2 FROM fc UNION ALL SELECT v2, v0 FROM fc),
ge AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT s src, t dst FROM sd UNION ALL SELECT t, s FROM sd) u)"""


def grid_edges(spark: SparkSession) -> DataFrame:
    return cut(mesh.faces_to_edges(grid(spark)[1]).select("src", "dst", F.lit(1.0).alias("w")))


def nation_fields(spark: SparkSession, d: str) -> DataFrame:
    """(v, k, x): per nation, 0 the customers' mean balance in thousands, 1 the suppliers'."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("v")).agg(F.round(F.avg("c_acctbal") / 1000, 6).alias("x"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("v")).agg(F.round(F.avg("s_acctbal") / 1000, 6).alias("x"))
    return cut(c.select("v", F.lit(0).alias("k"), "x").unionByName(s.select("v", F.lit(1).alias("k"), "x")))


FIELDS = """
fd AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) v, 0 k, round(avg(c_acctbal) / 1000, 6) x FROM customer GROUP BY 1
       UNION ALL SELECT CAST(s_nationkey AS BIGINT), 1, round(avg(s_acctbal) / 1000, 6) FROM supplier GROUP BY 1)"""


def region_seeds(spark: SparkSession, d: str) -> DataFrame:
    """(set_id, v): the nations of each region are one seed set."""
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("set_id"), F.col("n_nationkey").cast("long").alias("v"))


SEEDS = "sd AS (SELECT CAST(n_regionkey AS BIGINT) set_id, CAST(n_nationkey AS BIGINT) v FROM nation),\nvx AS (SELECT DISTINCT i v FROM a)"


def marginals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cost, p, q) among nations: cost 1 / (1 + trade / 100), p by customers, q by suppliers; nations without either are left out."""
    share = lambda t, c: table(spark, d, t).groupBy(F.col(c).cast("long").alias("v")).agg(F.count("*").alias("n"))
    scaled = lambda x: cut(x.crossJoin(F.broadcast(x.agg(F.sum("n").alias("s")))).select("v", (F.col("n") / F.col("s")).alias("x")))
    p, q = scaled(share("customer", "c_nationkey")), scaled(share("supplier", "s_nationkey"))
    every = p.select(F.col("v").alias("i")).crossJoin(q.select(F.col("v").alias("j")))
    cost = every.join(trade(spark, d), ["i", "j"], "left").select("i", "j", (1.0 / (1.0 + F.coalesce("x", F.lit(0.0)) / 100.0)).alias("x"))
    return cut(cost), p, q


MARGINALS = TRADE + """,
pn AS (SELECT CAST(c_nationkey AS BIGINT) v, CAST(count(*) AS DOUBLE) n FROM customer GROUP BY 1),
qn AS (SELECT CAST(s_nationkey AS BIGINT) v, CAST(count(*) AS DOUBLE) n FROM supplier GROUP BY 1),
mp AS MATERIALIZED (SELECT v, n / (SELECT sum(n) FROM pn) x FROM pn),
mq AS MATERIALIZED (SELECT v, n / (SELECT sum(n) FROM qn) x FROM qn),
co AS MATERIALIZED (SELECT mp.v i, mq.v j, 1.0 / (1.0 + coalesce(a.x, 0.0) / 100.0) x FROM mp CROSS JOIN mq LEFT JOIN a ON a.i = mp.v AND a.j = mq.v)"""


def balance_histograms(spark: SparkSession, d: str, bins: int = 8) -> DataFrame:
    """(h, a, b, x): by return flag, shares of line items on a full grid of quantity and discount bins, plus a floor."""
    rows = table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("h"),
        F.least(F.floor(F.col("l_quantity") * bins / 51), F.lit(bins - 1)).cast("long").alias("a"),
        F.least(F.floor(F.col("l_discount") * 100 * bins / 11 + 1e-6), F.lit(bins - 1)).cast("long").alias("b"),
    )
    counts = rows.groupBy("h", "a", "b").agg(F.count("*").alias("n"))
    totals = counts.groupBy("h").agg(F.sum("n").alias("s"))
    cells = spark.range(3 * bins * bins).select((F.col("id") % 3).cast("int").alias("h"), (F.floor(F.col("id") / 3) % bins).alias("a"), F.floor(F.col("id") / (3 * bins)).cast("long").alias("b"))
    return cut(cells.join(counts, ["h", "a", "b"], "left").join(totals, "h").select("h", "a", "b", (F.coalesce("n", F.lit(0)) / F.col("s") + 1e-4).alias("x")))


HISTOGRAMS = """
lr AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END h, CAST(least(floor(l_quantity * 8 / 51), 7) AS BIGINT) a,
              CAST(least(floor(l_discount * 100 * 8 / 11 + 1e-6), 7) AS BIGINT) b FROM lineitem),
ln AS (SELECT h, a, b, count(*) n FROM lr GROUP BY 1, 2, 3),
hx AS MATERIALIZED (SELECT c.h, c.a, c.b, coalesce(n, 0) / s + CAST(1e-4 AS DOUBLE) x
       FROM (SELECT CAST(x.range AS INTEGER) h, CAST(y.range AS BIGINT) a, CAST(z.range AS BIGINT) b FROM range(3) x CROSS JOIN range(8) y CROSS JOIN range(8) z) c
       LEFT JOIN ln USING (h, a, b) JOIN (SELECT h, CAST(sum(n) AS DOUBLE) s FROM ln GROUP BY 1) t ON t.h = c.h)"""
