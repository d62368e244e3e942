"""Vector functions over arrays of numbers, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(F.try_divide(x.cast("double"), n)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """One less the cosine distance, not below zero; 0 where a vector has no direction."""
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def literal(values: list[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])
