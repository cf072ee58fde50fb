"""Arithmetic on ``ARRAY<FLOAT>`` columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def head(v: Column, dims: int) -> Column:
    """The first ``dims`` numbers, normalised again."""
    return unit(F.slice(v, 1, dims))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b)))
