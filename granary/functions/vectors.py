"""Small vectors as arrays: drift, similarity, largest parts, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shares(a: Column) -> Column:
    return let(a, lambda v: let(_sum(v), lambda s: F.transform(v, lambda x: x / s)))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    grown = let(F.array_max(a).cast("double"), lambda top: F.transform(a, lambda x: F.exp((x.cast("double") - top) / temperature)))
    return _shares(grown)


def entropy(p: Column) -> Column:
    return _sum(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def agreement(a: Column, b: Column) -> Column:
    """Whether both are largest at the same place (the first of equal ones)."""
    first = lambda v: let(v, lambda x: F.array_position(x, F.array_max(x)))
    return first(a) == first(b)


def spread(a: Column) -> Column:
    """Variance of the parts."""
    return let(a, lambda v: let(_sum(F.transform(v, lambda x: x.cast("double"))) / F.size(v), lambda m: _sum(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))


def kl(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Divergence of two arrays that are made positive and sum to one first."""
    norm = lambda v: _shares(F.transform(v, lambda x: x.cast("double") + eps))
    return _sum(F.zip_with(norm(p), norm(q), lambda x, y: x * F.log(x / y)))


def top_parts(v: Column, k: int) -> Column:
    """Indices of the k parts of largest size; the first of equal ones."""
    parts = F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(parts), 1, k), lambda s: s["i"])
