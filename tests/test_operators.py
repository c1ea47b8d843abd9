"""Invariants of operators that SQL can not say."""

import json
import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dense
from fieldloom.functions.columns import exponential
from fieldloom.operators import blocks, factor, graphs, gromov, integrators, kernels, mesh, paths, planar, tasks, transport, trees
from fieldloom.operators import linalg as la
from fieldloom.sources import generate, meshes, results, store, trajectories
from fieldloom.streaming import incremental


def both_ways(pairs):
    return [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]


@pytest.fixture(scope="module")
def tree_edges(spark):
    return generate.random_tree(spark, 40, 1.0, seed=3).cache()


@pytest.fixture(scope="module")
def field(spark):
    return spark.range(40).select(F.col("id").alias("v"), F.lit(0).alias("k"), (F.col("id") % 7 - 3.0).alias("x")).cache()


def values(df):
    return {(r.v, r.k): r.x for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-7, abs_tol=1e-8) for k in a)


def test_tree_passing_equals_brute_force(tree_edges, field):
    exact = values(integrators.BruteForce(tree_edges, exponential(0.7)).integrate(field))
    fast = values(trees.mean_over_trees(trees.integrate(trees.from_bfs(tree_edges, 0), field, -0.7)))
    assert close(exact, fast)


def test_minimum_spanning_tree_of_a_tree_is_the_tree(tree_edges):
    assert trees.minimum_spanning(tree_edges).count() == 39


def test_spanning_trees_dominate_the_graph(spark):
    e = spark.createDataFrame(both_ways([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (0, 2, 1.5)]), "src long, dst long, w double")
    g = paths.all_pairs(e)
    for t in (trees.random_spanning(e, 2), trees.bartal(e, 2)):
        rows = t.collect()
        assert len(rows) == 8 and sum(r.parent is None for r in rows) == 2
    one = trees.random_spanning(e, 1)
    assert trees.distortion(trees.distances(one), g).where("ratio < 1 - 1e-9").count() == 0


def test_frt_clusters_are_laminar_and_its_tree_integrates(spark):
    e = spark.createDataFrame(both_ways([(i, i + 1, 1.0 + i % 3) for i in range(9)]), "src long, dst long, w double")
    d = paths.all_pairs(e)
    c = trees.frt(d, 0.75, lambda t, v: F.pmod(v * 7919 + 13, F.lit(101))).collect()
    top = max(r.level for r in c)
    names = {(r.node, r.level): r.cluster for r in c}
    assert len(names) == 10 * (top + 1)
    assert all(names[v, n].startswith(names[v, n - 1] + ">") for v in range(10) for n in range(1, top + 1))
    # sequential: first vertex in order within the radius, in the same cluster
    dist = {(r.i, r.j): r.x for r in d.collect()}
    order = sorted(range(10), key=lambda v: ((v * 7919 + 13) % 101, v))
    near = min(x for (i, j), x in dist.items() if i != j)
    for n in range(1, top + 1):
        for v in range(10):
            first = next(u for u in order if dist[v, u] < 0.75 * 2.0 ** (top - n) * near) if any(dist[v, u] < 0.75 * 2.0 ** (top - n) * near for u in order) else None
            assert names[v, n].rsplit(">", 1)[1] == str(first)
    t = trees.frt_tree(trees.frt(d, 0.75, lambda t, v: F.pmod(v * 7919 + 13, F.lit(101))), near).collect()
    assert sorted(r.node for r in t if r.node >= 0) == list(range(10)) and sum(r.parent is None for r in t) == 1


def test_separator_of_one_side_bridge(spark):
    e = spark.createDataFrame(both_ways([(i, i + 1, 1.0) for i in range(10)]), "src long, dst long, w double")
    parts = spark.createDataFrame([(v, 2 if v == 5 else int(v > 5)) for v in range(11)], "v long, part int")
    f = spark.createDataFrame([(v, 0, float(v)) for v in range(11)], "v long, k int, x double")
    exact = values(integrators.BruteForce(e, exponential(0.4)).integrate(f))
    assert close(values(integrators.Separator(e, parts, exponential(0.4)).integrate(f)), exact)


@pytest.mark.parametrize("threshold", [3, 8, 100])
def test_separators_of_a_path_are_exact(spark, threshold):
    e = spark.createDataFrame(both_ways([(i, i + 1, 1.0) for i in range(20)]), "src long, dst long, w double")
    f = spark.createDataFrame([(v, 0, float(v % 4)) for v in range(21)], "v long, k int, x double")
    exact = values(integrators.BruteForce(e, exponential(0.4)).integrate(f))
    assert close(values(factor.RecursiveSeparator(e, f.select("v"), exponential(0.4), threshold=threshold).integrate(f)), exact)


def test_matching_of_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(9, 2))
    c = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rows = [(0, s, i, j, float(c[i, j]), 0) for s in (0, 1) for i in range(9) for j in range(9)]
    pairs = spark.createDataFrame(rows, "pair long, side int, i long, j long, x double, label long")
    for most in (64, 4):
        got = gromov.recursive_matching(pairs, most).collect()
        assert len({r.i for r in got}) == len(got) == len({r.j for r in got}) and len(got) >= 8


@pytest.mark.parametrize("size,density,seed", [(3, 1.0, 0), (16, 0.7, 1), (120, 1.0, 2), (300, 0.7, 3), (300, 0.4, 4)])
def test_planar_separator_guarantees(size, density, seed):
    adj = planar.random_planar(size, density, seed)
    cost = dict(zip(adj, np.random.default_rng(seed).uniform(size=len(adj)).tolist(), strict=True)) if seed % 2 else dict.fromkeys(adj, 1.0)
    part = planar.separate(adj, cost)
    total = sum(cost.values())
    assert set(part) == set(adj)
    assert all(sum(cost[v] for v in adj if part[v] == k) <= 2 * total / 3 + 1e-9 for k in (0, 1))
    assert sum(p == 2 for p in part.values()) <= 2 * math.sqrt(2 * len(adj))
    assert not any({part[u], part[v]} == {0, 1} for u in adj for v in adj[u])


def test_random_features_match_the_dense_exponential(spark):
    points = generate.cloud(spark, 30).cache()
    f = spark.range(30).select(F.col("id").alias("v"), F.lit(0).alias("k"), F.sin("id").alias("x"))
    r = integrators.RandomFeatureDiffusion(points, 0.3, 0.05, 6)
    pos = np.array([x.pos for x in points.orderBy("v").collect()])
    a, b = integrators.features(pos, r.omega, r.ratio)
    want = (dense.expm(0.05 * a @ b.T) @ np.sin(np.arange(30))).real
    got = values(r.integrate(f))
    assert np.allclose([got[v, 0] for v in range(30)], want)


def test_taylor_and_krylov_match_the_dense_exponential(spark):
    e = generate.erdos_renyi(spark, 12, 0.4, 1).cache()
    m = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x"))
    a = np.zeros((12, 12))
    for r in m.collect():
        a[r.i, r.j] = r.x
    f = spark.range(12).select(F.col("id").alias("v"), F.lit(0).alias("k"), (F.col("id") + 1.0).alias("x"))
    want = dense.expm(0.2 * a) @ np.arange(1, 13)
    got = values(integrators.TaylorDiffusion(m, 0.2, 14).integrate(f))
    assert np.allclose([got[v, 0] for v in range(12)], want)
    assert np.allclose(dense.lanczos_expm(lambda x: 0.2 * a @ x, np.arange(1.0, 13), 12, 1.0), want)
    got = values(integrators.LanczosDiffusion(la.scale(m, 0.2), 10, 1.0).integrate(f))
    assert np.allclose([got.get((v, 0), 0.0) for v in range(12)], want, rtol=1e-4)


def test_kernel_invariants(spark):
    e = generate.erdos_renyi(spark, 10, 0.6, 2).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x")).cache()
    assert all(abs(r.x - 1) < 1e-9 for r in la.col_sums(kernels.random_walk(e, 3)).collect())
    a = np.zeros((10, 10))
    for r in e.collect():
        a[r.i, r.j] = r.x
    w = a / a.sum(0)
    want = 0.3 * np.linalg.inv(np.eye(10) - 0.7 * w)
    got = {(r.i, r.j): r.x for r in kernels.random_walk_with_restart(e, 0.3, 40).collect()}
    assert all(abs(got.get((i, j), 0.0) - want[i, j]) < 1e-5 for i in range(10) for j in range(10))
    d = {(r.i, r.j): r.x for r in kernels.diffusion_state_distance(e, 2).collect()}
    assert all(abs(d[i, j] - d[j, i]) < 1e-12 for i, j in d)
    with pytest.raises(ValueError):
        kernels.by_name(e, "nothing_1")


def test_exact_transport_against_all_assignments():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 6):
        c = rng.uniform(size=(n, n))
        plan = dense.transport(c, np.full(n, 1 / n), np.full(n, 1 / n))
        assert np.allclose(plan.sum(0), 1 / n) and np.allclose(plan.sum(1), 1 / n)
        assert abs((plan * c).sum() - min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n))) / n) < 1e-9
    p, q = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(7))
    plan = dense.transport(rng.uniform(size=(4, 7)), p, q)
    assert np.allclose(plan.sum(1), p) and np.allclose(plan.sum(0), q) and (plan >= 0).all()


def test_conditional_gradient_finds_a_copy():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(8, 2))
    c = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = rng.permutation(8)
    label = np.arange(8) % 4
    m = (label[:, None] != label[order][None]).astype(float)
    plan, cost = gromov.conditional_gradient(m, c, c[np.ix_(order, order)], np.full(8, 1 / 8), np.full(8, 1 / 8), 0.5)
    assert np.allclose(plan.sum(0), 1 / 8) and cost < 0.2


def test_sinkhorn_rows_are_exact(spark):
    cost = spark.createDataFrame([(i, j, abs(i - j) / 3.0) for i in range(4) for j in range(4)], "i long, j long, x double")
    p = spark.createDataFrame([(i, 0.25) for i in range(4)], "v long, x double")
    plan = transport.sinkhorn_converged(cost, p, p, 0.3)
    assert all(abs(r.x - 0.25) < 1e-9 for r in la.row_sums(plan).collect())


def test_grid_barycenter_in_three_dimensions(spark):
    n, rng = 4, np.random.default_rng(2)
    h = rng.dirichlet(np.ones(n**3), 2).reshape(2, n, n, n)
    rows = [(k, x, y, z, float(h[k, x, y, z])) for k in range(2) for x in range(n) for y in range(n) for z in range(n)]
    df = spark.createDataFrame(rows, "h int, gx long, gy long, gz long, x double")
    kernel = transport.grid_kernel(spark, n, 0.2, -1.0, 1.0)
    got = transport.grid_barycenter(df, ["gx", "gy", "gz"], dict.fromkeys(("gx", "gy", "gz"), kernel), {0: 0.3, 1: 0.7}, 2)
    t = np.linspace(-1, 1, n)
    g = np.exp(-((t[:, None] - t) ** 2) / 0.2)
    conv = lambda f: np.einsum("kabc,ax,by,cz->kxyz", f, g, g, g)
    u = np.ones_like(h)
    for _ in range(2):
        kb = conv(h / conv(u))
        bar = np.exp((np.array([0.3, 0.7])[:, None, None, None] * np.log(u * kb)).sum(0))
        u = bar / kb
    assert np.allclose([r.x for r in got.orderBy("gx", "gy", "gz").collect()], bar.ravel())


def test_mesh_invariants(spark):
    points, faces = mesh.grid(spark, 5, 4)
    lap = mesh.cotangent_laplacian(points, faces).cache()
    assert all(abs(r.x) < 1e-9 for r in la.row_sums(lap).collect())
    areas = mesh.vertex_areas(points, faces).cache()
    assert abs(areas.agg(F.sum("a")).first()[0] - 1) < 1e-9
    f = points.select("v", F.lit(0).alias("k"), (F.col("v") % 3 + 0.0).alias("x"))
    out = {r.v: r.x for r in mesh.heat(lap, areas, f, 0.05).collect()}
    a = {r.v: r.a for r in areas.collect()}
    left = {v: a[v] * out[v] for v in out}
    for r in lap.collect():
        left[r.i] += 0.05 * r.x * out[r.j]
    assert all(abs(left[v] - a[v] * (v % 3)) < 1e-9 for v in left)
    ring = {r.v: r.adj for r in mesh.ordered_neighbours(faces).collect()}
    edges = {(r.src, r.dst) for r in mesh.faces_to_edges(faces).collect()}
    assert all((v, w) in edges for v in ring for w in ring[v])


def test_mesh_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    (tmp_path / "b.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    corners = np.zeros(1, np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("tag", "<u2")]))
    corners["corners"] = [[[0, 0, 0], [1, 0, 0], [0, 1, 0]]]
    (tmp_path / "d.stl").write_bytes(bytes(80) + struct.pack("<I", 1) + corners.tobytes())
    points, faces = meshes.read(spark, f"file://{tmp_path}")
    count = lambda df: {r.graph_id.rsplit("/", 1)[1]: r["count"] for r in df.groupBy("graph_id").count().collect()}
    assert count(points) == {"a.obj": 4, "b.off": 3, "c.ply": 3, "d.stl": 3}
    assert count(faces) == {"a.obj": 2, "b.off": 1, "c.ply": 1, "d.stl": 1}


def test_trajectory_files(spark, tmp_path):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda number, data: bytes([number << 3 | 2]) + varint(len(data)) + data
    world = np.arange(12, dtype="<f4").reshape(2, 2, 3)
    kinds = np.array([[[0], [1]]], "<i4")
    entries = b"".join(part(1, part(1, k.encode()) + part(2, part(1, part(1, v.tobytes())))) for k, v in (("world_pos", world), ("node_type", kinds)))
    message = part(1, entries)
    (tmp_path / "x.tfrecord").write_bytes(struct.pack("<Q", len(message)) + bytes(4) + message + bytes(4))
    meta = json.dumps({"trajectory_length": 2, "features": {"world_pos": {"type": "dynamic", "shape": [2, 2, 3], "dtype": "float32"}, "node_type": {"type": "static", "shape": [1, 2, 1], "dtype": "int32"}}})
    rows = trajectories.read(spark, f"file://{tmp_path}", meta).orderBy("t", "v").collect()
    assert [(r.t, r.v, r.world_pos, r.node_type) for r in rows] == [(t, v, world[t, v].tolist(), v) for t in range(2) for v in range(2)]


def test_kernel_store(spark, tmp_path):
    e = generate.erdos_renyi(spark, 6, 0.8, 3).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x"))
    s = store.KernelStore(spark, str(tmp_path / "kernels"))
    first = {tuple(r) for r in s.get("icn", e).collect()}
    assert s.ids() == ["icn"] and {tuple(r) for r in s.load("icn").collect()} == first


def test_stream_of_changes_adds_up(spark, tmp_path):
    spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "v long, k int, x double").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(0, 0, 3.0)], "v long, k int, x double").write.mode("append").parquet(str(tmp_path / "in"))
    kernel = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5)], "i long, j long, x double")
    changes = spark.readStream.schema("v long, k int, x double").parquet(str(tmp_path / "in"))
    q = incremental.integrate(changes, kernel).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {(r.v, r.x) for r in spark.table("sums").collect()} == {(0, 5.0), (1, 2.0)}


def entries(df):
    return {(r.i, r.j): r.x for r in df.collect()}


def matrix_of(rows, n):
    out = np.zeros((n, n))
    for (i, j), x in rows.items():
        out[i, j] = x
    return out


@pytest.mark.parametrize("n,p", [(40, 0.3), (500, 0.2)])
def test_heat_kernel_is_the_exponential_for_large_norms(spark, n, p):
    e = generate.erdos_renyi(spark, n, p, 42).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x")).cache()
    a = matrix_of(entries(e), n)
    values, vectors = np.linalg.eigh(np.diag(a.sum(0)) - a)
    want = (vectors * np.exp(-0.7 * values)) @ vectors.T
    got = kernels.by_name(e, "hk_0.7").toPandas()
    out = np.zeros((n, n))
    out[got["i"], got["j"]] = got["x"]
    assert np.abs(out - want).max() < 1e-10 and abs(out.sum(0) - 1).max() < 1e-9


def test_blocks_multiply_and_invert(spark):
    rng = np.random.default_rng(0)
    n = 21
    x = rng.uniform(size=(n, n)) + n * np.eye(n)
    df = spark.createDataFrame([(3 * i, 3 * j, float(x[i, j])) for i in range(n) for j in range(n)], "i long, j long, x double")
    at = blocks.places(kernels.vertices_of(df))
    assert [r["at"] for r in at.orderBy("v").collect()] == list(range(n))
    back = lambda blk: matrix_of({(i // 3, j // 3): v for (i, j), v in entries(blocks.to_entries(blk, at)).items()}, n)
    b = blocks.from_entries(df, at)
    assert np.allclose(back(b), x)
    assert np.allclose(back(blocks.multiply(b, b, 0.5)), 0.5 * x @ x)
    assert np.allclose(back(blocks.add((b, 2.0), (blocks.transpose(b), -1.0))), 2 * x - x.T)
    assert np.allclose(back(blocks.inverse(b, n)), np.linalg.inv(x))
    assert np.allclose(back(blocks.expm(blocks.add((b, 0.1)), n)), dense.expm(0.1 * x))
    assert np.allclose(blocks.norms(b), (x.sum(0).max(), x.sum(1).max()))
    assert np.allclose(back(blocks.apply(b, b, lambda p, q: p * q)), x * x)


def test_blocks_beyond_one_block(spark):
    n = 300
    rng = np.random.default_rng(1)
    x = np.diag(np.full(n, 4.0)) + np.diag(rng.uniform(size=n - 1), 1) + np.diag(rng.uniform(size=n - 1), -1)
    i, j = np.nonzero(x)
    df = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, x double")
    at = blocks.places(kernels.vertices_of(df))
    b = blocks.from_entries(df, at)
    for got, want in ((blocks.inverse(b, n), np.linalg.inv(x)), (blocks.expm(b, n), dense.expm(x))):
        pdf = blocks.to_entries(got, at).toPandas()
        out = np.zeros((n, n))
        out[pdf["i"], pdf["j"]] = pdf["x"]
        assert np.allclose(out, want, rtol=1e-8, atol=1e-9)


def test_state_distance_of_the_limit(spark):
    e = generate.erdos_renyi(spark, 12, 0.6, 2).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x")).cache()
    a = matrix_of(entries(e), 12)
    p, pi = a / a.sum(1)[:, None], a.sum(1) / a.sum()
    rows = np.linalg.inv(np.eye(12) - p - pi[None])
    got = entries(kernels.by_name(e, "dsd_-1"))
    assert len(got) == 132 and all(abs(x - np.abs(rows[i] - rows[j]).sum()) < 1e-7 for (i, j), x in got.items())


@pytest.mark.parametrize("rate", [-0.3, 0.75, 20.0])
def test_diffusion_is_exact_for_any_rate(spark, rate):
    e = generate.erdos_renyi(spark, 12, 0.4, 1)
    m = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("x")).cache()
    a = matrix_of(entries(m), 12)
    f = spark.range(12).select(F.col("id").alias("v"), F.lit(0).alias("k"), (F.col("id") + 1.0).alias("x"))
    values_, vectors = np.linalg.eigh(a)
    want = (vectors * np.exp(rate * values_)) @ vectors.T @ np.arange(1.0, 13)
    got = values(integrators.TaylorDiffusion(m, rate).integrate(f))
    assert np.allclose([got.get((v, 0), 0.0) for v in range(12)], want, rtol=1e-8)


def test_krylov_takes_all_columns_at_once(spark):
    m = generate.erdos_renyi(spark, 10, 0.5, 3).select(F.col("src").alias("i"), F.col("dst").alias("j"), (0.3 * F.col("w")).alias("x")).cache()
    a = matrix_of(entries(m), 10)
    f = spark.range(10).select(F.col("id").alias("v"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).withColumn("x", F.when(F.col("k") == 2, 0.0).otherwise(F.col("v") + 1.0 + F.col("k"))).cache()
    got = values(integrators.LanczosDiffusion(m, 10, -1.0).integrate(f))
    for k in (0, 1):
        want = dense.expm(-a) @ (np.arange(10) + 1.0 + k)
        assert np.allclose([got.get((v, k), 0.0) for v in range(10)], want, rtol=1e-6)
    assert all(abs(x) < 1e-12 for (v, k), x in got.items() if k == 2)


def test_squares_of_kernels_through_integrators(spark):
    points = generate.cloud(spark, 25, seed=4).cache()
    p = spark.range(25).select(F.col("id").alias("v"), (1.0 + F.col("id") % 3).alias("x"))
    r = integrators.RandomFeatureDiffusion(points, 0.3, 0.001, 6)
    pos = np.array([x.pos for x in points.orderBy("v").collect()])
    a, b = integrators.features(pos, r.omega, r.ratio)
    k = dense.expm(0.001 * a @ b.T).real
    low = gromov.LowRank(pos, 0.3, 0.001, 6)
    mass = 1.0 + np.arange(25) % 3
    want = (k * k) @ mass
    got = {x.v: x.x for x in integrators.square_integrate(r, p).collect()}
    assert np.allclose([got[v] for v in range(25)], want) and np.allclose(low.squared(mass), want) and np.allclose(low @ np.eye(25), k)

    class Plain:  # an integrator that only integrates
        integrate = r.integrate

    got = {x.v: x.x for x in integrators.square_integrate(Plain(), p).collect()}
    assert np.allclose([got[v] for v in range(25)], np.diag(k @ np.diag(mass) @ k))


def test_proximal_method_on_strips_equals_the_dense_one(spark):
    clouds = [generate.cloud(spark, n, seed=s, gaussian=False).cache() for n, s in ((150, 1), (140, 2))]
    plan, cost = gromov.proximal_clouds(*clouds, 0.3, 1e-4, 6, 0.2, 3, 2)
    pos = [np.array([r.pos for r in c.orderBy("v").collect()]) for c in clouds]
    c1, c2 = (gromov.LowRank(x, 0.3, 1e-4, 6) @ np.eye(len(x)) for x in pos)
    p, q = (np.full(len(x), 1 / len(x)) for x in pos)
    t = np.outer(p, q)
    for _ in range(3):
        c = gromov.square_tensor(c1, c2, p, q, t)
        k, a = np.exp(-c / 0.2) * t, p
        for _ in range(2):
            b = q / (k.T @ a)
            a = p / (k @ b)
        t = a[:, None] * k * b[None]
    got = entries(plan)
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(t[i, j] - x) < 1e-12 for (i, j), x in got.items())
    assert abs(cost - (gromov.square_tensor(c1, c2, p, q, t) * t).sum()) < 1e-9


@pytest.mark.parametrize("loss,line", [("square_loss", "closed"), ("square_loss", "armijo"), ("kl_loss", "armijo")])
def test_conditional_gradient_never_rises(loss, line):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(size=(7, 2)), rng.uniform(size=(9, 2))
    c1, c2 = (0.1 + np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) for z in (x, y))
    p, q = np.full(7, 1 / 7), np.full(9, 1 / 9)
    costs = [gromov.conditional_gradient(np.zeros((7, 9)), c1, c2, p, q, 1.0, n, loss=loss, line=line)[1] for n in (1, 3, 10)]
    assert costs[0] >= costs[1] - 1e-12 >= costs[2] - 2e-12
    assert gromov.closed_step(2.0, -1.0) == 0.25 and gromov.closed_step(-1.0, 0.5) == 1.0 and gromov.closed_step(-1.0, 2.0) == 0.0
    assert gromov.armijo(lambda s: (s - 0.3) ** 2, 0.09, -0.6) == 0.5


def test_conditional_gradient_on_features_equals_the_dense_one(spark):
    pos = [np.random.default_rng(s).normal(size=(8, 3)) for s in (1, 2)]
    low = [gromov.LowRank(x, 0.3, 0.005, 6) for x in pos]
    p = np.full(8, 1 / 8)
    m = np.random.default_rng(3).uniform(size=(8, 8))
    a = gromov.conditional_gradient(m, *low, p, p, 0.5)
    b = gromov.conditional_gradient(m, *(k @ np.eye(8) for k in low), p, p, 0.5)
    assert abs(a[1] - b[1]) < 1e-9
    rows = [(0, s, v, pos[s][v].tolist(), v % 2) for s in (0, 1) for v in range(8)]
    got = gromov.compare_clouds(spark.createDataFrame(rows, "pair long, side int, v long, pos array<double>, label long"), 0.3, 0.005, 6, 0.5).collect()
    assert abs(sum(r.x for r in got) - 1) < 1e-9


def test_fused_barycenter_keeps_what_is_fixed(spark):
    rng = np.random.default_rng(7)
    rows, feats = [], []
    for g in range(3):
        x = rng.uniform(size=(5, 2))
        c = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        rows += [(g, i, j, float(c[i, j])) for i in range(5) for j in range(5)]
        feats += [(g, i, 0, float(i % 2)) for i in range(5)]
    graphs_ = spark.createDataFrame(rows, "g long, i long, j long, x double").cache()
    features = spark.createDataFrame(feats, "g long, v long, k int, x double").cache()
    structure, y = gromov.fused_barycenter(graphs_, features, 5, 0.5, 2)
    c = matrix_of(entries(structure), 5)
    assert np.allclose(c, c.T) and all(0 <= r.x <= 1 for r in y.collect())
    fixed = spark.createDataFrame([(i, 0, 0.5) for i in range(5)], "v long, k int, x double")
    assert {(r.v, r.x) for r in gromov.fused_barycenter(graphs_, features, 5, 0.5, 1, fixed_features=fixed)[1].collect()} == {(i, 0.5) for i in range(5)}
    assert entries(gromov.fused_barycenter(graphs_, features, 5, 0.5, 1, fixed_structure=structure)[0]) == entries(structure)


def test_recursive_partitions_cover_every_node(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(6, 2)), rng.normal(size=(6, 2)) + 8])
    w = np.exp(-np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    one = [(i, j, float(w[i, j])) for i in range(12) for j in range(12) if i != j]
    got = gromov.recursive_partition(spark.createDataFrame(one, "i long, j long, x double"), 2, 4, 3, beta=0.05).collect()
    assert sorted(r.v for r in got) == list(range(12))
    many = spark.createDataFrame([(g, i, j, v) for g in (0, 1) for i, j, v in one], "g long, i long, j long, x double").cache()
    parts = gromov.recursive_multi_partition(many, 2, 4, 2).cache()
    assert sorted((r.g, r.v) for r in parts.collect()) == [(g, v) for g in (0, 1) for v in range(12)]
    assert sum(len(r.nodes) for r in gromov.node_sets(parts).collect()) == 24
    pairs = gromov.recursive_indirect_matching(many, 0, 1, 2, 4, 2).collect()
    assert pairs and len({r.i for r in pairs}) == len(pairs) == len({r.j for r in pairs})


def test_masses_stay_a_distribution(spark):
    cs = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(4) for j in range(4)], "i long, j long, x double")
    p = spark.createDataFrame([(i, 0.25) for i in range(4)], "v long, x double")
    plan, ps = gromov.proximal_mass(cs, cs, p.select("v"), p, 0.5, 2, 5, 0.1, 0.05)
    assert abs(sum(r.x for r in ps.collect()) - 1) < 1e-12 and abs(sum(r.x for r in plan.collect()) - 1) < 1e-6
    stopped, _ = gromov.proximal(cs, cs, p, p, 0.5, 50, 3, bound=1e-3, entropic=True)
    assert abs(sum(r.x for r in stopped.collect()) - 1) < 1e-6


def test_loops_stop_when_nothing_changes(spark):
    """A loose tolerance ends a loop early: the result is that of as few rounds."""
    n = 4
    kernel = spark.createDataFrame([(i, j, math.exp(-abs(i - j))) for i in range(n) for j in range(n)], "i long, j long, x double")
    h = spark.createDataFrame([(i, k, 0.1 + 0.2 * ((i + k) % 3)) for i in range(n) for k in (0, 1)], "v long, k int, x double").cache()
    through = integrators.Materialised(kernel)
    a, b = (transport.convolutional_barycenter(h, {0: 1.0, 1: 1.0}, through, iterations=r, tolerance=t) for r, t in ((2, None), (50, 1e9)))
    assert {r.v: r.x for r in a.collect()} == pytest.approx({r.v: r.x for r in b.collect()})
    first, second = (h.where(F.col("k") == k).withColumn("k", F.lit(0)) for k in (0, 1))
    a, b = (transport.convolutional_distance(first, second, through, iterations=r, tolerance=t).first().x for r, t in ((2, None), (50, 1e9)))
    assert a == pytest.approx(b)
    cost = spark.createDataFrame([(i, j, abs(i - j) / 3.0) for i in range(n) for j in range(n)], "i long, j long, x double")
    p = spark.createDataFrame([(i, 0.25) for i in range(n)], "v long, x double")
    assert entries(transport.log_sinkhorn(cost, p, p, 0.5, 50, threshold=1e9)) == pytest.approx(entries(transport.log_sinkhorn(cost, p, p, 0.5, 1)))


def test_separators_found_elsewhere(spark):
    """The planar separator, and slices of another width, plugged into the recursion."""
    adj = planar.grid_embedding(5, 4)
    e = spark.createDataFrame([(u, w, 1.0) for u in adj for w in adj[u]], "src long, dst long, w double").cache()
    lists = spark.createDataFrame(list(adj.items()), "v long, adj array<long>")
    f = spark.createDataFrame([(v, 0, 1.0 + v % 3) for v in adj], "v long, k int, x double").cache()
    r = factor.RecursiveSeparator(e, f.select("v"), exponential(0.3), threshold=15, finder=factor.by_embedding(lists))
    assert r.slices is not None
    got, exact = values(r.integrate(f)), values(integrators.BruteForce(e, exponential(0.3)).integrate(f))
    assert got.keys() == exact.keys() and np.mean([abs(got[v] - exact[v]) / exact[v] for v in exact]) < 0.35
    parts = spark.createDataFrame([(v, 2 if v % 5 == 2 else int(v % 5 > 2)) for v in adj], "v long, part int")
    plain = integrators.Separator(e, parts, exponential(0.3))
    wide = integrators.Separator(e, parts, exponential(0.3), clustering=lambda d: F.floor(d / 1.0))
    assert close(values(wide.integrate(f)), values(plain.integrate(f)))
    assert close(values(plain.squared().integrate(f)), values(integrators.Separator(e, parts, exponential(0.6)).integrate(f)))


def test_conjugate_gradients_solve_what_one_task_solves(spark):
    points, faces = mesh.grid(spark, 4, 3)
    lap, areas = mesh.cotangent_laplacian(points, faces).cache(), mesh.vertex_areas(points, faces).cache()
    f = points.select("v", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), (F.col("v") % 3 + 0.0).alias("x")).withColumn("x", F.col("x") * F.col("k") + 1.0)
    assert close(values(mesh.heat(lap, areas, f, 0.05)), values(mesh.heat(lap, areas, f, 0.05, one_task=1)))


def test_small_operators(spark):
    frames = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, 4.0], 1)], "v long, world_pos array<double>, node_type int")
    moved = mesh.noisy(frames.withColumn("target_world_pos", F.col("world_pos")), 0.1, 0.1, 3).orderBy("v").collect()
    assert moved[1].world_pos == [3.0, 4.0] and moved[0].world_pos != [1.0, 2.0]
    assert all(abs((t - o) - 0.9 * (w - o)) < 1e-9 for t, w, o in zip(moved[0].target_world_pos, moved[0].world_pos, [1.0, 2.0], strict=True))
    v = spark.range(1000).withColumnRenamed("id", "v")
    share = generate.known_mask(v, 0.8, 1)
    assert 0.75 < share.count() / 1000 < 0.85 and sorted(share.collect()) == sorted(generate.known_mask(v, 0.8, 1).collect())
    assert generate.choices(v, 3, 7).groupBy("set_id").count().where("count = 7").count() == 3
    draws = v.select(generate.geometric_number(0.25, F.col("v")).alias("x"))
    assert abs(draws.agg(F.avg("x")).first()[0] - 4) < 0.5 and draws.agg(F.min("x")).first()[0] == 1
    tree = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0), (1, 0, 3.0), (1, 1, 2.0)], "tree_id long, v long, x double").withColumn("k", F.lit(0))
    assert {(r.v, r.x) for r in trees.least_over_trees(tree).collect()} == {(0, 1.0), (1, 2.0)}
    clock = tasks.Evaluator()
    assert clock.measure("range", lambda: spark.range(5)).count() == 5
    assert [r.name for r in clock.table(spark).collect()] == ["range"] and clock.rows[0][1] > 0
    grid = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.9), ("b", 1.0, 0.1)], "method string, parameter double, cosine double")
    assert {(r.method, r.parameter) for r in tasks.best_of_grid(grid).collect()} == {("a", 2.0), ("b", 1.0)}
    assert tasks.is_psd(np.eye(2)) and not tasks.is_psd(-np.eye(2))
    assert integrators.taylor_plan(0.0) == (1, 1) and all(s * t < 40 * max(1, n) for n in (0.1, 1, 30, 500) for s, t in [integrators.taylor_plan(n)])


def test_generated_graphs(spark):
    e = generate.regular(spark, 20, 5, 2)
    assert e.groupBy("src").count().where("count <> 5").count() == 0 and e.count() == 100
    with pytest.raises(ValueError):
        generate.regular(spark, 5, 3)
    points, near = generate.geometric(spark, 60, 0.3, seed=5)
    pos = {r.v: np.array(r.pos) for r in points.collect()}
    want = {(u, w) for u in pos for w in pos if u != w and round(float(np.linalg.norm(pos[u] - pos[w])), 9) <= 0.3}
    assert {(r.src, r.dst) for r in near.collect()} == want


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev"])
def test_cells_find_every_near_pair(spark, metric):
    points = generate.cloud(spark, 80, 3, 8, gaussian=True).cache()
    rows = lambda df: {(r.src, r.dst, round(r.w, 8)) for r in df.collect()}
    every = graphs._blockwise(points, metric, lambda d, same, ids: np.nonzero((d <= 0.7) & ~same))
    assert rows(graphs.epsilon_graph(points, 0.7, metric)) == rows(every)


def test_results_and_configurations(spark, tmp_path):
    frames = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [2.0])], "traj_id long, v long, world_pos array<double>")
    results.write_snapshots(frames, str(tmp_path / "frames"))
    assert results.read_snapshots(spark, str(tmp_path / "frames"), [1]).first().world_pos == [2.0] and results.read_snapshots(spark, str(tmp_path / "frames")).count() == 2
    for kind in ("parquet", "csv", "json"):
        results.write(spark.range(3), str(tmp_path / kind), kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).count() == 3
    with pytest.raises(ValueError):
        results.write(spark.range(3), str(tmp_path / "x"), "xls")
    results.log(spark, str(tmp_path / "log"), "one", "two")
    results.log(spark, str(tmp_path / "log"), "three")
    assert spark.read.text(str(tmp_path / "log")).count() == 3
    assert results.config('{"a": {"sigma": [1, 2]}}') == {"a": {"sigma": [1, 2]}}
    got = results.grid(spark, {"a": {"sigma": [1, 2], "eps": 0.5}, "b": {"m": 16}}).collect()
    assert sorted((r.method, sorted(r.parameters.items())) for r in got) == [("a", [("eps", 0.5), ("sigma", 1.0)]), ("a", [("eps", 0.5), ("sigma", 2.0)]), ("b", [("m", 16.0)])]


def test_binary_mesh_files(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffB", *p, 7) for p in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))) + struct.pack("<Biiii", 4, 0, 1, 2, 3)
    (tmp_path / "a.ply").write_bytes(head + body)
    points, faces = meshes.read(spark, f"file://{tmp_path}")
    assert [r.pos for r in points.orderBy("v").collect()] == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]]
    assert sorted((r.v0, r.v1, r.v2) for r in faces.collect()) == [(0, 1, 2), (0, 2, 3)]
    text = [r.line for r in meshes.to_obj(points, faces).collect()]
    assert text[0].startswith("v ") and text[-1] == "f 1 3 4"
    (tmp_path / "b.obj").write_text("\n".join(text))
    again = meshes.parse("b.obj", (tmp_path / "b.obj").read_bytes())
    assert again[0].tolist() == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]] and len(again[1]) == 2


@pytest.mark.parametrize("one_task", [paths.ONE_TASK, 0])
def test_components_of_chains_take_few_rounds(spark, monkeypatch, one_task):
    """A long chain whose ids go up and down, a ring, and single vertices, by one task and by joins alone."""
    rng, kept = np.random.default_rng(3), []
    chain, ring = [int(x) for x in rng.permutation(300)], list(range(1000, 1040))
    links = [*zip(chain, chain[1:]), *zip(ring, ring[1:] + ring[:1])]
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in links for a, b in ((x, y), (y, x))], "src long, dst long, w double")
    vertices = spark.createDataFrame([(v,) for v in [*chain, *ring, 5000, -7]], "v long")
    plain = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: kept.append(1) or plain(df))
    got = {r.v: r.component for r in paths.components(vertices, edges, one_task).collect()}
    assert got == {v: 0 for v in chain} | {v: 1000 for v in ring} | {5000: 5000, -7: -7}
    assert len(kept) == 1 if one_task else len(kept) < 30


@pytest.mark.parametrize("metric", ["cosine", "cityblock", "sqeuclidean"])
def test_all_pairs_without_a_shuffle(spark, monkeypatch, metric):
    """Several blocks, the last ones not full: every pair once, and no point is dealt to groups."""
    monkeypatch.setattr(graphs, "BLOCK", 16)
    pos = np.random.default_rng(5).normal(size=(75, 4))
    points = spark.createDataFrame([(7 * i, [float(x) for x in p]) for i, p in enumerate(pos)], "v long, pos array<double>").repartition(5)
    out = graphs.pairwise(points, metric)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.x for r in out.collect()}
    a, b = pos[:, None], pos[None]
    want = {"cosine": 1 - (a * b).sum(2) / np.sqrt((a * a).sum(2) * (b * b).sum(2)), "cityblock": abs(a - b).sum(2), "sqeuclidean": ((a - b) ** 2).sum(2)}[metric]
    assert out.count() == len(got) and got.keys() == {(7 * i, 7 * j) for i in range(75) for j in range(75) if i != j}
    assert all(abs(x - want[i // 7, j // 7]) < 2e-9 for (i, j), x in got.items())
    assert graphs.pairwise(points.limit(0), metric).count() == 0


def test_all_pairs_are_stored_in_little_more_than_half_their_distances(spark, tmp_path):
    """Both ways round of a distance are near each other, so a file of (i, j, x) holds it once: 8.5 bytes a row before."""
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(2000, 4)))], "v long, pos array<double>")
    graphs.pairwise(points, "sqeuclidean").write.parquet(str(tmp_path / "pairs"), compression="snappy")
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2000 * 1999
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * 2000 * 1999


@pytest.mark.parametrize("metric", ["sqeuclidean", "cityblock"])
def test_pairs_that_meet_once_are_given_both_ways(spark, monkeypatch, metric):
    """Blocks and strips that are not full, copies of points, and an id that two blocks hold."""
    monkeypatch.setattr(graphs, "BLOCK", 16)
    monkeypatch.setattr(graphs, "MIRROR", 5)
    pos = np.random.default_rng(6).integers(-3, 4, (71, 3)) / 8
    ids = [*range(70), 0]
    out = graphs.pairwise(spark.createDataFrame([(v, p.tolist()) for v, p in zip(ids, pos, strict=True)], "v long, pos array<double>"), metric)
    by = {"sqeuclidean": lambda a, b: ((a - b) ** 2).sum(), "cityblock": lambda a, b: abs(a - b).sum()}[metric]
    want = sorted((v, u, by(a, b)) for v, a in zip(ids, pos, strict=True) for u, b in zip(ids, pos, strict=True) if v != u)
    assert sorted(map(tuple, out.collect())) == want


def test_squares_by_a_product_round_as_their_sums_do():
    rng = np.random.default_rng(1)
    for scale in (1e-160, 1e-6, 1.0, 10.0, 300.0, 1e5, 1e160, np.inf):
        a, b = rng.normal(size=(60, 64)), rng.normal(size=(50, 64))
        halves = np.round(a * 32) / 2**15, np.round(b * 32) / 2**15
        copies = a, np.concatenate([a[:30], a[:20] + rng.integers(0, 2, (20, 64)) * 2.0**-20])
        for x, y in ((a, b), halves, copies):
            with np.errstate(all="ignore"):
                x, y = x * scale, y * scale
                got, want = graphs._rounded_squares(x, y), graphs.rounded(graphs._squares(x, y))
            assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[got == 0]).any()


def test_distances_round_halves_as_sql_does():
    import duckdb

    x = np.concatenate([np.arange(-40, 40) / 2**10 + 9, (np.arange(200) + 0.5) / 1e9, [-1.5e-9, 0.49999999999999994e-9, 2.5e-9, 2.0**53 + 1]])
    want = [duckdb.execute("select round(cast(? as double), 9) + 0.0", [float(v)]).fetchall()[0][0] for v in x]
    assert graphs.rounded(x).tolist() == want


@pytest.mark.parametrize("configuration", [False, True])
def test_tiles_of_rewired_graphs_equal_the_whole_matrix(spark, monkeypatch, configuration):
    monkeypatch.setattr(kernels, "TILE", 16)
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(x)) for x in rng.integers(0, 60, (150, 2)).tolist() if x[0] != x[1]} | {(7, 2**60 + 1)}
    edges = spark.createDataFrame(both_ways([(a, b, 1.0) for a, b in pairs]), "src long, dst long, w double")

    def icn(a):
        s = np.sqrt(np.maximum(a.sum(0), 1))
        return (a @ a + 2 * a) / np.outer(s, s)

    want = {(r.i, r.j): (r.mean, r.std) for r in kernels.rewired_statistics(edges, 3, 40, icn, 1, configuration).collect()}
    rows = kernels.rewired_interconnectedness(edges, 3, 40, 1, configuration).collect()
    got = {(r.i, r.j): (r.mean, r.std) for r in rows}
    n = len({v for p in pairs for v in p})
    assert len(rows) == len(got) == n * n and got.keys() == want.keys()
    assert all(abs(a - b) < 1e-12 for k in want for a, b in zip(want[k], got[k]))
    assert all(r.std is None for r in kernels.rewired_interconnectedness(edges, 1, 40).limit(5).collect())


@pytest.mark.parametrize(("terms", "rate"), [(3, -0.1), (None, -1e-4)])
def test_diffusion_without_edges_equals_that_of_edges(spark, monkeypatch, terms, rate):
    monkeypatch.setattr(graphs, "BLOCK", 16)
    pos = np.random.default_rng(4).uniform(size=(70, 3))
    points = spark.createDataFrame([(3 * i, [float(x) for x in p]) for i, p in enumerate(pos)], "v long, pos array<double>").repartition(3)
    field = spark.createDataFrame([(3 * i, k, float((i * 5 + k) % 11 - 5)) for i in range(70) for k in (2, 9)] + [(1, 2, 4.5)], "v long, k int, x double")
    edges = graphs.epsilon_graph(points, 0.8, "cityblock").cache()
    want = values(integrators.epsilon_diffusion(edges, rate, terms).integrate(field))
    stored, plain = [], integrators.cut
    monkeypatch.setattr(integrators, "cut", lambda df: stored.append(df.columns) or plain(df))
    got = values(integrators.NearDiffusion(points, 0.8, rate, terms).integrate(field))
    assert close(got, want)
    assert all(c == ["b", "z"] for c in stored)  # arrays of blocks, no edges


@pytest.mark.parametrize(("n", "m"), [(40, 40), (40, 53), (1, 7), (9, 1)])
def test_plans_have_no_cheaper_cycle(n, m):
    """Marginals hold, and no cycle of entries with room lowers the cost, so the plan is optimal; ties and zero costs included."""
    rng = np.random.default_rng(n + m)
    cost = np.round(rng.uniform(size=(n, m)), 1)
    p, q = np.full(n, 1 / n), rng.dirichlet(np.ones(m))
    plan = dense.transport(cost, p, q)
    assert np.allclose(plan.sum(1), p, atol=1e-12) and np.allclose(plan.sum(0), q, atol=1e-12) and plan.min() >= 0
    u, v = np.zeros(n), np.zeros(m)
    for _ in range(n + m + 1):
        v = np.minimum(v, (u[:, None] + cost).min(0))
        u = np.minimum(u, np.where(plan > 1e-12, v - cost, np.inf).min(1))
    assert (v <= (u[:, None] + cost).min(0) + 1e-9).all()


def test_plans_of_changing_costs_begin_at_the_last_tree():
    """Each plan is optimal, with ties, rows and columns without mass and even masses; slowly changing costs take seconds, not minutes."""
    rng = np.random.default_rng(4)

    def optimal(cost, plan):
        u, v = np.zeros(len(plan)), np.zeros(len(plan[0]))
        for _ in range(len(u) + len(v) + 1):
            v = np.minimum(v, (u[:, None] + cost).min(0))
            u = np.minimum(u, np.where(plan > 1e-12, v - cost, np.inf).min(1))
        return bool((v <= (u[:, None] + cost).min(0) + 1e-9).all())

    some = rng.dirichlet(np.ones(30)) * (np.arange(30) % 3 > 0)
    for p, q in ((some / some.sum(), np.full(20, 0.05)), (np.full(24, 1 / 24), np.full(24, 1 / 24)), (np.full(24, 1 / 24), np.full(36, 1 / 36))):
        exact, cost = dense.Transport(p, q), np.round(rng.uniform(size=(len(p), len(q))), 1)
        for _ in range(5):
            plan = exact.plan(cost)
            assert np.allclose(plan.sum(1), p, atol=1e-12) and np.allclose(plan.sum(0), q, atol=1e-12) and plan.min() >= 0 and optimal(cost, plan)
            cost = cost + np.round(rng.uniform(-0.2, 0.2, cost.shape), 1)
        assert np.isnan(exact.plan(cost * np.nan)).all() and optimal(cost, exact.plan(cost))

    p, q = np.full(500, 1 / 500), np.full(560, 1 / 560)
    a, b, began = rng.normal(size=(500, 8)), rng.normal(size=(560, 8)), time.process_time()
    exact = dense.Transport(p, q)
    for k in range(20):
        plan = exact.plan(-(a + 0.01 * k) @ b.T)
    assert time.process_time() - began < 40
    assert optimal(-(a + 0.19) @ b.T, plan)


def test_conditional_gradient_makes_one_product_a_round():
    class Counted(np.ndarray):
        made = 0

        def __matmul__(self, other):
            Counted.made += 1
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(3)
    c1, c2 = (abs(x[:, None] - x[None]) for x in (rng.normal(size=20), rng.normal(size=23)))
    p, q = np.full(20, 0.05), np.full(23, 1 / 23)
    plan, cost = gromov.conditional_gradient(np.zeros((20, 23)), c1.view(Counted), c2, p, q, iterations=6, tolerance=0.0)
    assert Counted.made <= 9  # one for the constant part, the first plan, the last value, and each round: 21 before
    want = (gromov.square_tensor(c1, c2, p, q, plan) * plan).sum()
    assert abs(cost - want) < 1e-12


def test_plans_of_clouds_are_those_of_their_distances(spark):
    rng = np.random.default_rng(8)
    rows = [(0, side, 100 * side + v, [float(x) for x in rng.normal(size=3)], v % 3) for side, n in ((0, 9), (1, 11)) for v in range(n)]
    clouds = spark.createDataFrame(rows, "pair long, side int, v long, pos array<double>, label long")
    pairs = [(0, s, v, u, round(math.dist(a, b), 9), y) for _, s, v, a, y in rows for _, z, u, b, _ in rows if s == z and u != v]
    want = gromov.compare(spark.createDataFrame(pairs, "pair long, side int, i long, j long, x double, label long"), alpha=0.5).collect()
    got = gromov.compare(clouds, alpha=0.5).collect()
    assert {(r.i, r.j) for r in got} == {(r.i, r.j) for r in want} and abs(got[0].cost - want[0].cost) < 1e-8
    x = {(r.i, r.j): r.x for r in want}
    assert all(abs(r.x - x[r.i, r.j]) < 1e-8 for r in got)


@pytest.mark.parametrize("include_self", [False, True])
def test_nearest_points_of_many_blocks(spark, monkeypatch, include_self):
    """Copies, distances that are equal once rounded, far points whose squares lose digits, an id that two rows have and values that are no numbers."""
    monkeypatch.setattr(graphs, "BLOCK", 8)
    rng = np.random.default_rng(7)
    pos = np.concatenate([rng.normal(size=(150, 5)), np.zeros((20, 5)), rng.integers(-1, 2, (60, 5)) + 4e-10 * rng.integers(0, 3, (60, 5)), 1e6 + rng.normal(size=(20, 5)), [[np.nan] * 5, [np.inf] * 5, [1e200] * 5]])
    ids = rng.permutation(len(pos))
    ids[3] = ids[170]
    points = spark.createDataFrame([(int(v), p.tolist()) for v, p in zip(ids, pos, strict=True)], "v long, pos array<double>")
    with np.errstate(all="ignore"):
        d = graphs.rounded(graphs._METRIC["euclidean"](pos, pos))
    want = []
    for v in set(ids.tolist()):
        near = sorted((d[a, b], int(u)) for a in np.flatnonzero(ids == v) for b, u in enumerate(ids) if (include_self or u != v) and np.isfinite(d[a, b]))
        want += [(v, u, w) for w, u in near[:6]]
    assert sorted((r.src, r.dst, r.w) for r in graphs.knn_graph(points, 6, include_self=include_self).collect()) == sorted(want)


def test_nearest_points_are_ranked_among_few(spark, monkeypatch):
    """A task keeps k rows of each point for all blocks that it reads: k of each block before."""
    monkeypatch.setattr(graphs, "BLOCK", 8)
    points = spark.range(512).select(F.col("id").alias("v"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("pos"))
    assert graphs._nearest(points, 4, False).count() <= 512 * 4 * 8
