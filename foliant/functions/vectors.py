"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def fault(v: Column, dim: int) -> Column:
    """Why a vector can't be used: missing, length, not_finite, zero; null if it can."""
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return F.when(v.isNull(), "missing").when(F.size(v) != dim, "length").when(bad, "not_finite").when(F.forall(v, lambda x: x == 0), "zero")
