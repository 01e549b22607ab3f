"""Column functions on vectors; products in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("cosine", "l2", "ip")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def score_of(distance: Column, space: Column) -> Column:
    """A similarity from a stored distance: squared L2 of unit vectors halves, an inner product stays; null is 1."""
    s = F.when(space == "l2", 1.0 - distance / 2.0).when(space == "ip", distance).otherwise(1.0 - distance)
    return F.coalesce(s, F.lit(1.0))
