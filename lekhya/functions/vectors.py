"""Dense and sparse vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if a vector is null or their sizes differ."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)); keeps the order."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error if it has not ``dim`` elements."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit("vector has not the size "), F.lit(str(dim)))).cast("array<float>"))

