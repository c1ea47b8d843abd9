"""Registered queries against their SQL in DuckDB, over whole tables."""

import math

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from fieldloom.plans import queries as plans  # noqa: E402

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["interp_knn_label", "mutual_knn", "metric_columns", "adjacency_to_coo", "induced_subgraph", "matvec_field", "icn_kernel", "rw_kernel_2", "projection_zscore", "node_ranking", "apsp_minplus", "mst_edges", "sinkhorn_knopp_5it", "sinkhorn_log_3it", "conv_barycenter_2d", "gw_tensor_product", "target_distribution", "cot_laplacian", "vertex_areas", "trajectory_lag_lead", "histogram_3d", "center_scale",
        "heat_kernel", "rfd_integrate", "heat_step", "metric_columns_truth", "mass_update", "gw_proximal_integrators", "vertex_normals"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) else str(x)
    return sorted((tuple(clean(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.SQL) <= set(plans.QUERIES)
    assert entry.entry(spark).limit(1).count() == 1


def test_label_pairs_cover_all_labels(spark, tmp_path):
    labels = [0, 0, 1, 1, 2, 2, 3, 3, 3, 8, 8, 9, 9, 6, 6, 4, 5, 5, None]  # 6 is without 7, 4 is one point
    spark.createDataFrame([(i, [float(i), 1.0], y) for i, y in enumerate(labels)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.pair, r.side, r.i, r.j) for r in plans._label_pairs(spark, str(tmp_path)).collect()}
    assert got == {(a // 2, a % 2, i, j) for i, a in enumerate(labels) for j, b in enumerate(labels) if a == b and i != j and a in (0, 1, 2, 3, 8, 9)}


@pytest.mark.parametrize("name", ["fgw_cg", "recursive_match"])
def test_every_labelled_row_takes_part(spark, duck, name):
    got = entry.queries()[name](spark, DIR).collect()
    found = {(r.pair, v) for r in got for v in (r.i, r.j)}
    sizes = dict(duck.sql("select label, count(*) from embeddings group by 1").fetchall())
    rows = duck.sql("select label // 2, vec_id from embeddings").fetchall()
    if name == "fgw_cg":  # even masses leave no row without a partner
        assert found == set(rows)
    else:  # one to one
        assert found <= set(rows) and {p for p, _ in found} == {label // 2 for label in sizes}


def test_random_features_sum_the_terms_of_their_sql(spark, tmp_path):
    """A cloud so large that sixteen terms are not the exponential."""
    x = lambda n: F.sin(F.col("id") * n).cast("float")
    cloud = spark.range(60000).select(F.col("id").alias("vec_id"), F.array(x(1), x(2), x(3)).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    cloud.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = entry.queries()["rfd_integrate"](spark, str(tmp_path)).toPandas().sort_values(["v", "k"], ignore_index=True)
    want = c.sql(entry.oracle_sql()["rfd_integrate"]).df().sort_values(["v", "k"], ignore_index=True)
    assert got[["v", "k"]].equals(want[["v", "k"]].astype(got[["v", "k"]].dtypes))
    assert ((got["x"] - want["x"]).abs() <= 1e-6 + 1e-9 * want["x"].abs()).all()
