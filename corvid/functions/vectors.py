"""Column functions on vectors (array<float>); all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.text import col


def as_double(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; null if either is null or the lengths differ."""
    x = F.zip_with(as_double(a), as_double(b), lambda p, q: p * q)
    return F.when(F.size(col(a)) == F.size(col(b)), F.aggregate(x, F.lit(0.0), lambda s, v: s + v))


def norm(c: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_double(c), F.lit(0.0), lambda s, v: s + v * v))


def l2_normalize(c: str | Column) -> Column:
    """The vector at length 1; an all-zero one stays as it is."""
    n = norm(c)
    return F.when(n > 0, F.transform(as_double(c), lambda v: v / n)).otherwise(as_double(c))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null where a vector is zero, null or of another length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance_score(c: str | Column) -> Column:
    """1 / (1 + d) for a positive distance, else 1."""
    return F.when(col(c) > 0, 1.0 / (1.0 + col(c))).otherwise(F.lit(1.0))
