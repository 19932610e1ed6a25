"""Similarity and distance of two ``array<double>`` columns, as JVM-side expressions.

Arrays of different or zero length raise, as do no other inputs; null arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tokens import let

VectorFn = Callable[[Column, Column], Column]


def ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """``num / den`` in double precision, and ``otherwise`` where ``den`` is 0."""
    return F.when(den == 0, F.lit(otherwise)).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(ok, value).otherwise(F.raise_error(F.lit("vectors must have the same, positive length")).cast("double"))


def _pairwise(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: term(x, y).cast("double")))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, _pairwise(a, b, lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero."""
    return _checked(a, b, _clamped(ratio(_pairwise(a, b, lambda x, y: x * y), l2_norm(a) * l2_norm(b))))


def pearson(a: Column, b: Column) -> Column:
    """Product-moment correlation; 0 if either vector is constant."""
    centre = lambda v: let(lambda s: F.transform(s["v"], lambda x: x - s["m"]), v=v, m=_total(v) / F.size(v))
    return cosine(centre(a), centre(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all non-zero positions; 1 if there are none."""
    both = _pairwise(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("int"))
    either = _pairwise(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("int"))
    return _checked(a, b, ratio(both, either, 1.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared non-zero positions over those of the smaller set; 0 if one is empty."""
    count = lambda v: _total(F.transform(v, lambda x: (x != 0).cast("double")))
    both = _pairwise(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("int"))
    return _checked(a, b, ratio(both, F.least(count(a), count(b))))


def euclidean(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_pairwise(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _checked(a, b, _pairwise(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return _checked(a, b, F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))).cast("double"))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    """The p-norm of the difference, p of at least 1; infinity is Chebyshev."""
    if not p >= 1:
        raise ValueError("p must be at least 1")
    if p == float("inf"):
        return chebyshev(a, b)
    return _checked(a, b, F.pow(_pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p)))


def hamming(a: Column, b: Column) -> Column:
    """Share of positions that differ."""
    return _checked(a, b, _pairwise(a, b, lambda x, y: (x != y).cast("int")) / F.size(a))


def canberra(a: Column, b: Column) -> Column:
    """Sum of |x - y| / (|x| + |y|), where 0 / 0 counts nothing."""
    return _checked(a, b, _pairwise(a, b, lambda x, y: ratio(F.abs(x - y), F.abs(x) + F.abs(y))))


SIMILARITIES: dict[str, VectorFn] = {"cosine": cosine, "pearson": pearson, "jaccard": jaccard, "overlap_coefficient": overlap_coefficient}
DISTANCES: dict[str, VectorFn] = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "minkowski": minkowski, "hamming": hamming, "canberra": canberra}
