"""Column expressions: rounding, vector metrics, kernels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    return F.round(x, digits) + F.lit(0.0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _zipped(f):
    return lambda a, b: total(F.zip_with(a, b, f))


dot = _zipped(lambda x, y: x * y)
l1 = _zipped(lambda x, y: F.abs(x - y))
sqeuclidean = _zipped(lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cosine(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(_zipped(lambda x, y: F.pow(F.abs(x - y), F.lit(p)))(a, b), F.lit(1.0 / p))


def canberra(a: Column, b: Column) -> Column:
    return _zipped(lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))(a, b)


def braycurtis(a: Column, b: Column) -> Column:
    return l1(a, b) / _zipped(lambda x, y: F.abs(x + y))(a, b)


def hamming(a: Column, b: Column) -> Column:
    return _zipped(lambda x, y: F.when(x != y, 1.0).otherwise(0.0))(a, b) / F.size(a)


def correlation(a: Column, b: Column) -> Column:
    centred = lambda v: F.transform(v, lambda x: x - total(v) / F.size(v))
    return cosine(centred(a), centred(b))


def jaccard(a: Column, b: Column) -> Column:
    """Share of unequal positions among those where either is non-zero."""
    either = _zipped(lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0))(a, b)
    return F.when(either > 0, _zipped(lambda x, y: F.when((x != y) & ((x != 0) | (y != 0)), 1.0).otherwise(0.0))(a, b) / either).otherwise(0.0)


def weighted_minkowski(weights: list[float], p: float = 2.0):
    """The metric (sum of |w (x - y)|^p)^(1/p)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return lambda a, b: F.pow(total(F.zip_with(w, F.zip_with(a, b, lambda x, y: x - y), lambda w, d: F.pow(F.abs(w * d), F.lit(float(p))))), F.lit(1.0 / p))


def seuclidean(variances: list[float]):
    """The Euclidean metric with each dimension over its variance."""
    v = F.array(*[F.lit(float(x)) for x in variances])
    return lambda a, b: F.sqrt(total(F.zip_with(v, F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda v, d: d / v)))


def mahalanobis(inverse: list[list[float]]):
    """The metric sqrt((x - y)' M (x - y)) of an inverse covariance matrix M."""
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in inverse]

    def metric(a: Column, b: Column) -> Column:
        d = F.zip_with(a, b, lambda x, y: x - y)
        return F.sqrt(F.greatest(total(F.zip_with(d, F.array(*[dot(r, d) for r in rows]), lambda x, y: x * y)), F.lit(0.0)))

    return metric


def _agreement(f):
    """A metric of truth values (x <> 0) from its counts: both true, only the first, only the second, neither."""

    def metric(a: Column, b: Column) -> Column:
        both = lambda p, q: _zipped(lambda x, y: F.when(((x != 0) == p) & ((y != 0) == q), 1.0).otherwise(0.0))(a, b)
        return f(both(True, True), both(True, False), both(False, True), both(False, False))

    return metric


def _share(above: Column, below: Column) -> Column:
    return F.when(below != 0, above / below).otherwise(0.0)


dice = _agreement(lambda tt, tf, ft, ff: _share(tf + ft, 2 * tt + tf + ft))
kulsinski = _agreement(lambda tt, tf, ft, ff: (2 * (tf + ft) + ff) / (2 * (tf + ft) + tt + ff))
matching = _agreement(lambda tt, tf, ft, ff: (tf + ft) / (tt + tf + ft + ff))
rogerstanimoto = _agreement(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft)))
russellrao = _agreement(lambda tt, tf, ft, ff: (tf + ft + ff) / (tt + tf + ft + ff))
sokalmichener = rogerstanimoto
sokalsneath = _agreement(lambda tt, tf, ft, ff: _share(2 * (tf + ft), tt + 2 * (tf + ft)))
yule = _agreement(lambda tt, tf, ft, ff: F.when(tf * ft != 0, 2 * tf * ft / (tt * ff + tf * ft)).otherwise(0.0))


def rotated(values: Column, by: Column | int) -> Column:
    """An array whose first ``by`` values went to its end, counted round."""
    n = F.size(values)
    at = F.when(n > 0, F.pmod(F.lit(by) if isinstance(by, int) else by, n)).otherwise(0).cast("int")
    return F.concat(F.slice(values, at + 1, n), F.slice(values, F.lit(1), at))


METRICS = {
    "cityblock": l1, "sqeuclidean": sqeuclidean, "euclidean": euclidean, "cosine": cosine, "chebyshev": chebyshev, "minkowski": minkowski,
    "canberra": canberra, "braycurtis": braycurtis, "hamming": hamming, "correlation": correlation, "jaccard": jaccard, "dice": dice, "kulsinski": kulsinski, "matching": matching,
    "rogerstanimoto": rogerstanimoto, "russellrao": russellrao, "sokalmichener": sokalmichener, "sokalsneath": sokalsneath, "yule": yule,
}
#: Metrics that take parameters first.
WITH_PARAMETERS = {"wminkowski": weighted_minkowski, "seuclidean": seuclidean, "mahalanobis": mahalanobis}


def exponential(sigma: float):
    """The kernel exp(-sigma * d) of a distance column."""
    return lambda d: F.exp(-F.lit(float(sigma)) * d)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))
