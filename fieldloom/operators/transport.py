"""Entropic and convolutional optimal transport. Histograms are (v, x) or (h, v, x); costs and plans (i, j, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import linalg as la
from .stage import cut


def _times(kernel: DataFrame, a: DataFrame, by: str, to: str) -> DataFrame:
    """(to, s): sum over ``by`` of kernel * a."""
    return kernel.join(a.select(F.col("v").alias(by), F.col("x").alias("a")), by).groupBy(to).agg(F.sum(F.col("x") * F.col("a")).alias("s"))


def _divided(p: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    return p.join(sums.withColumnRenamed(key, "v"), "v").select("v", (F.col("x") / F.col("s")).alias("x"))


def sinkhorn(cost: DataFrame, p: DataFrame, q: DataFrame, beta: float, iterations: int, start: DataFrame | None = None, every: int = 4, first: DataFrame | None = None, scalings: bool = False):
    """The plan after ``iterations`` scalings b = q / K'a, a = p / K b with K = exp(-cost / beta), times ``start`` where it is given (proximal step).

    a is p at first, or ``first`` (v, x) from an earlier call; with ``scalings`` the result is (plan, a, b).
    """
    kernel = cost.select("i", "j", F.exp(-F.col("x") / beta).alias("x"))
    kernel = cut(la.hadamard(kernel, start) if start is not None else kernel)
    a, b = p.select("v", "x") if first is None else first, None
    for n in range(1, iterations + 1):
        b = _divided(q, _times(kernel, a, "i", "j"), "j")
        a = _divided(p, _times(kernel, b, "j", "i"), "i")
        if n % every == 0:
            a, b = cut(a), cut(b)
    ends = kernel.join(a.select(F.col("v").alias("i"), F.col("x").alias("a")), "i").join(b.select(F.col("v").alias("j"), F.col("x").alias("b")), "j")
    plan = ends.select("i", "j", (F.col("a") * F.col("x") * F.col("b")).alias("x"))
    return (plan, a, b) if scalings else plan


def sinkhorn_converged(cost: DataFrame, p: DataFrame, q: DataFrame, beta: float, bound: float = 1e-6, most: int = 200, every: int = 10) -> DataFrame:
    """sinkhorn() with more iterations until the plan's column sums are within ``bound`` of q; one number is collected for each ``every`` iterations."""
    done, a = 0, None
    while True:
        plan, a, _ = sinkhorn(cost, p, q, beta, every, first=a, scalings=True)
        plan, a, done = cut(plan), cut(a), done + every
        gap = la.col_sums(plan).withColumnRenamed("x", "s").join(q, "v").agg(F.sum(F.abs(F.col("s") - F.col("x")))).first()[0]
        if (gap or 0.0) < bound or done >= most:
            return plan


def power_cost(first: DataFrame, second: DataFrame, p: float = 2.0) -> DataFrame:
    """(i, j, x): sum over dimensions of |x - y|^p between the points (v, pos) of two clouds."""
    from ..functions.columns import total

    left, right = first.select(F.col("v").alias("i"), F.col("pos").alias("a")), second.select(F.col("v").alias("j"), F.col("pos").alias("b"))
    gap = total(F.zip_with("a", "b", lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))
    return left.crossJoin(right).select("i", "j", gap.alias("x"))  # as many rows as the cost has entries


def even(points: DataFrame) -> DataFrame:
    """(v, x): the same mass for each vertex."""
    return points.select("v").crossJoin(F.broadcast(points.agg(F.count("*").alias("n")))).select("v", (1.0 / F.col("n")).alias("x"))  # one row is sent


def log_sinkhorn(cost: DataFrame, p: DataFrame, q: DataFrame, eps: float, iterations: int, threshold: float | None = None) -> DataFrame:
    """(i, j, x): the plan in the log domain; u and v take turns, each by a stable log of a sum of exponentials.

    With ``threshold`` it stops when u changes by less in sum; one number is collected for each iteration then.
    """
    cost = cut(cost)
    u, v = p.select("v", F.lit(0.0).alias("x")), q.select("v", F.lit(0.0).alias("x"))

    def update(mass, old, other, mine, theirs):
        m = cost.join(other.select(F.col("v").alias(theirs), F.col("x").alias("o")), theirs).join(old.select(F.col("v").alias(mine), F.col("x").alias("c")), mine)
        m = m.select(F.col(mine).alias("v"), ((F.col("c") + F.col("o") - F.col("x")) / eps).alias("m"))
        top = m.groupBy("v").agg(F.max("m").alias("top"))
        lse = m.join(top, "v").groupBy("v", "top").agg(F.log(F.sum(F.exp(F.col("m") - F.col("top")))).alias("l")).select("v", (F.col("l") + F.col("top")).alias("l"))
        return mass.withColumnRenamed("x", "mass").join(lse, "v").join(old, "v").select("v", (eps * (F.log("mass") - F.col("l")) + F.col("x")).alias("x"))

    for _ in range(iterations):
        old, u = u, cut(update(p, u, v, "i", "j"))
        v = cut(update(q, v, u, "j", "i"))
        if threshold is not None and (u.join(old.withColumnRenamed("x", "o"), "v").agg(F.sum(F.abs(F.col("x") - F.col("o")))).first()[0] or 0.0) < threshold:
            break
    ends = cost.join(u.select(F.col("v").alias("i"), F.col("x").alias("u")), "i").join(v.select(F.col("v").alias("j"), F.col("x").alias("w")), "j")
    return ends.select("i", "j", F.exp((F.col("u") + F.col("w") - F.col("x")) / eps).alias("x"))


def transport_cost(plan: DataFrame, cost: DataFrame, reduction: str = "sum") -> DataFrame:
    """(x): the sum of plan times cost, or its mean over the plan's rows and columns' cells."""
    if reduction not in ("sum", "mean"):
        raise ValueError(f"unknown reduction {reduction}; known: sum, mean")
    if reduction == "mean":
        return la.hadamard(plan, cost).agg(F.avg("x").alias("x"))
    return la.inner(plan, cost)


# ---- with an integrator as a black box ---------------------------------------------------


def _weighted(f: DataFrame, area: DataFrame | None) -> DataFrame:
    return f if area is None else f.join(area, "v").select("v", "k", (F.col("x") * F.col("a")).alias("x"))


def _ratio(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.join(q.withColumnRenamed("x", "y"), ["v", "k"]).select("v", "k", (F.col("x") / F.col("y")).alias("x"))


def _change(new: DataFrame, old: DataFrame) -> float:
    """The mean absolute change of a field."""
    keys = [c for c in new.columns if c != "x"]
    return new.join(old.withColumnRenamed("x", "o"), keys).agg(F.avg(F.abs(F.col("x") - F.col("o")))).first()[0] or 0.0


def convolutional_distance(first: DataFrame, second: DataFrame, integrator, area: DataFrame | None = None, iterations: int = 100, eps: float = 2.2204e-16, tolerance: float | None = None) -> DataFrame:
    """(k, x): distances between histograms (v, k, x) of equal k after fixed scalings through the integrator. ``area`` is (v, a).

    With ``tolerance`` it stops when no scaling changes by more in the mean; one number is collected for each iteration then.
    """
    first, second = (h.select("v", "k", (F.col("x") + eps).alias("x")) for h in (first, second))
    aw = _weighted(first.select("v", "k", F.lit(1.0).alias("x")), area)
    v = w = av = None
    for n in range(iterations):
        v = cut(_ratio(second, integrator.integrate(aw)))
        av = _weighted(v, area)
        old, w = w, cut(_ratio(first, integrator.integrate(av)))
        aw = _weighted(w, area)
        if tolerance is not None and old is not None and _change(w, old) <= tolerance:
            break
    total = (first.select("v").distinct().agg(F.count("*").cast("double").alias("t")) if area is None else area.agg(F.sum("a").alias("t"))).select(F.log("t").alias("t"))
    log = lambda f: _weighted(f, area).withColumnRenamed("x", "af").join(f, ["v", "k"]).select("v", "k", (F.col("af") * F.log("x")).alias("x"))
    lw, lv = log(w), log(v)
    left = av.withColumnRenamed("x", "av").join(lv.withColumnRenamed("x", "lv"), ["v", "k"]).crossJoin(F.broadcast(total)).select("v", "k", (F.col("t") * F.col("av") + F.col("lv")).alias("l"))
    terms = left.join(integrator.integrate(aw), ["v", "k"]).select("k", (F.col("l") * F.col("x")).alias("x"))
    terms = terms.unionByName(av.withColumnRenamed("x", "av").join(integrator.integrate(lw), ["v", "k"]).select("k", (F.col("av") * F.col("x")).alias("x")))
    return terms.groupBy("k").agg(F.sqrt(F.greatest(F.sum("x"), F.lit(0.0))).alias("x"))


def convolutional_barycenter(hists: DataFrame, weights: dict[int, float], integrator, area: DataFrame | None = None, iterations: int = 20, normalise: bool = False, tolerance: float | None = None) -> DataFrame:
    """(v, x): the barycenter of histograms (v, k, x) with the weights of their k, after fixed Bregman projections; with ``tolerance``, until it changes by less in the mean."""
    total = sum(weights.values())
    alpha = F.element_at(F.create_map(*[F.lit(x) for k, a in weights.items() for x in (int(k), a / total)]), F.col("k").cast("int"))
    v = hists.select("v", "k", F.lit(1.0).alias("x"))
    ones = cut(integrator.integrate(v)) if normalise else None
    through = lambda f: _ratio(integrator.integrate(f), ones) if normalise else integrator.integrate(f)
    bar = None
    for _ in range(iterations):
        w = cut(_ratio(hists, through(_weighted(v, area))))
        d = v.withColumnRenamed("x", "p").join(through(_weighted(w, area)), ["v", "k"]).select("v", "k", F.greatest(F.col("p") * F.col("x"), F.lit(1e-300)).alias("d"))
        d = cut(d)
        old, bar = bar, cut(d.groupBy("v").agg(F.exp(F.sum(alpha * F.log("d"))).alias("x")))
        if tolerance is not None and old is not None and _change(bar, old) <= tolerance:
            break
        v = cut(v.withColumnRenamed("x", "p").join(d, ["v", "k"]).join(bar, "v").select("v", "k", (F.col("p") * F.col("x") / F.col("d")).alias("x")))
    return bar


# ---- separable grids -----------------------------------------------------------------------


def grid_kernel(spark, n: int, reg: float, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(a, b, g): exp(-(t_a - t_b)^2 / reg) on n even points of [lo, hi]."""
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    r = spark.range(n)
    both = r.select(F.col("id").alias("a")).crossJoin(r.select(F.col("id").alias("b")))
    gap = (F.col("a") - F.col("b")) * F.lit(step)
    return both.select("a", "b", F.exp(-gap * gap / reg).alias("g"))


def convolve(hist: DataFrame, axes: list[str], kernels: dict[str, DataFrame]) -> DataFrame:
    """(h, axes..., x) convolved along one axis after the other: one join with a small table for each, never one with a kernel over all cells."""
    out = hist
    for axis in axes:
        keys = ["h", *[a for a in axes if a != axis]]
        out = out.join(kernels[axis], F.col(axis) == F.col("a")).groupBy(*keys, F.col("b").alias("_to")).agg(F.sum(F.col("x") * F.col("g")).alias("x")).withColumnRenamed("_to", axis)
    return out


def grid_barycenter(hist: DataFrame, axes: list[str], kernels: dict[str, DataFrame], weights: dict[int, float], iterations: int = 10, floor: float = 1e-30) -> DataFrame:
    """(axes..., x): the barycenter of histograms (h, axes..., x) on a full grid, by separable convolutions. Works for two, three or more axes."""
    keys = ["h", *axes]
    alpha = F.element_at(F.create_map(*[F.lit(x) for k, a in weights.items() for x in (int(k), float(a))]), F.col("h").cast("int"))
    u = hist.select(*keys, F.lit(1.0).alias("u"))
    bar = None
    for _ in range(iterations):
        conv = lambda f: convolve(f, axes, kernels)
        ku = conv(u.withColumnRenamed("u", "x")).withColumnRenamed("x", "ku")
        b = hist.join(ku, keys).select(*keys, (F.col("x") / F.greatest("ku", F.lit(floor))).alias("x"))
        kb = cut(conv(b).withColumnRenamed("x", "kb"))
        both = u.join(kb, keys)
        bar = cut(both.groupBy(*axes).agg(F.exp(F.sum(alpha * F.log(F.greatest(F.col("u") * F.col("kb"), F.lit(floor))))).alias("x")))
        u = cut(kb.join(bar, axes).select(*keys, (F.col("x") / F.greatest("kb", F.lit(floor))).alias("u")))
    return bar


def wasserstein_1d(mu: DataFrame, nu: DataFrame, sigma: float, window: int, iterations: int) -> DataFrame:
    """(x): sigma^2 * mean of mu log v + nu log w on a line of cells (v, x), with a Gaussian window of odd width, normalised to sum 1."""
    n = mu.count()
    half = window // 2
    offsets = mu.sparkSession.range(-half, half + 1).select(F.col("id").alias("o"), F.exp(-F.col("id") * F.col("id") / (2.0 * sigma * sigma)).alias("g"))
    offsets = cut(offsets.crossJoin(F.broadcast(offsets.agg(F.sum("g").alias("s")))).select("o", (F.col("g") / F.col("s")).alias("g")))

    def smooth(f):  # each cell meets the cells of its window only
        return f.crossJoin(F.broadcast(offsets)).groupBy((F.col("v") + F.col("o")).alias("v")).agg((F.sum(F.col("x") * F.col("g")) / n).alias("s"))  # window rows are sent

    w = mu.select("v", F.lit(1.0).alias("x"))
    v = w
    for _ in range(iterations):
        v = cut(mu.join(smooth(w), "v").select("v", (F.col("x") / F.col("s")).alias("x")))
        w = cut(nu.join(smooth(v), "v").select("v", (F.col("x") / F.col("s")).alias("x")))
    both = mu.withColumnRenamed("x", "m").join(nu.withColumnRenamed("x", "n"), "v").join(v.withColumnRenamed("x", "a"), "v").join(w.withColumnRenamed("x", "b"), "v")
    return both.agg((sigma * sigma * F.sum(F.col("m") * F.log("a") + F.col("n") * F.log("b")) / n).alias("x"))
