"""Arithmetic on feature vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine for vectors of length one. Vectors of unequal length give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once; inside a function over an array it would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalize(v: Column) -> Column:
    """``v`` divided by its length; null where the length is zero or not finite."""

    def divided(v: Column, norm: Column) -> Column:
        fine = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
        return F.when(fine, F.transform(v, lambda x: x.cast("double") / norm))

    return _bound(v, lambda v: _bound(F.sqrt(squared_norm(v)), lambda norm: divided(v, norm)))


def reaches(score: Column, t: float) -> Column:
    """``score >= t``, false for NaN (which Spark orders above all numbers)."""
    return (score >= F.lit(t)) & ~F.isnan(score)
