"""Vectors and score lists as column expressions: evaluated in the JVM, no Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: an expression that a lambda mentions is else computed at each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, accumulated in double from the first dimension on; null if either side is null."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column | str, eps: float = 0.0) -> Column:
    """a / |a|, as doubles; a zero vector is unchanged."""
    size = norm(a) + eps
    return F.when(size > 0, F.transform(col(a), lambda x: x.cast("double") / size)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)


def _depth(values: Column, k: int | Column) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.greatest(F.lit(1), F.least(k.cast("int"), F.size(values)))


def topk_mean(values: Column | str, k: int | Column) -> Column:
    """Mean of the k largest: k = 1 is the maximum, k >= n the mean; null for an empty list."""
    v = col(values)
    return F.when(F.size(v) > 0, mean(F.slice(F.sort_array(v, asc=False), F.lit(1), _depth(v, k))))


def bottomk_mean(values: Column | str, k: int | Column) -> Column:
    """Mean of the k smallest; k = 1 is the minimum."""
    v = col(values)
    return F.when(F.size(v) > 0, mean(F.slice(F.sort_array(v, asc=True), F.lit(1), _depth(v, k))))


def product(values: Column | str) -> Column:
    return F.aggregate(col(values), F.lit(1.0), lambda s, x: s * x.cast("double"))


def power_mean(values: Column | str, p: float, shift: Column | float) -> Column:
    """(mean((x + shift) ** p)) ** (1 / p) - shift."""
    s = F.lit(shift) if isinstance(shift, float | int) else shift
    raised = F.transform(col(values), lambda x: F.pow(x.cast("double") + s, F.lit(p)))
    return F.pow(mean(raised), F.lit(1 / p)) - s


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over their hull; 0 for an empty hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(hull > 0, overlap / hull).otherwise(F.lit(0.0))


def maxsim(query_tokens: Column | str, doc_tokens: Column | str, pool: Callable[[Column], Column] = F.array_max) -> Column:
    """Late interaction: the sum over query tokens of the pooled similarities to the document's tokens."""
    per_token = F.transform(col(query_tokens), lambda q: pool(F.transform(col(doc_tokens), lambda d: dot(q, d))))
    return F.aggregate(per_token, F.lit(0.0), lambda s, x: s + x)
