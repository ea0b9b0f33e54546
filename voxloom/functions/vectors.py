"""Vector functions on array columns, native, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; 1 where either side has no length."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) | (nb == 0), 1.0).otherwise(1 - dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
