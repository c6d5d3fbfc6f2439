"""Vector expressions in double precision, and their validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalized(a: Column, eps: float = 1e-8) -> Column:
    n = norm(a) + eps
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def error(a: Column, dim: int) -> Column:
    """Why a vector is refused; null: it is valid."""
    return (F.when(a.isNull() | (F.size(a) == 0), "EMPTY").when(F.size(a) != dim, "DIMENSION").when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "NOT_FINITE")
            .when(F.exists(a, lambda x: F.abs(x) > 100), "LARGE"))
