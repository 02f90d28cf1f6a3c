"""Expressions over embedding vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_vector(values: Sequence[float]) -> Column:
    """A vector known before the query runs, as a constant."""
    return F.lit([float(v) for v in values])


def dot(x: Column, y: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(x: Column) -> Column:
    """Euclidean length."""
    squares = F.aggregate(
        x, F.lit(0.0), lambda total, a: total + a.cast("double") * a.cast("double")
    )
    return F.sqrt(squares)


def cosine_similarity(x: Column, y: Column) -> Column:
    """Cosine of the angle between two vectors, NULL when either has no length."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def cosine_distance(x: Column, y: Column) -> Column:
    """``1 - cosine`` kept within 0 and 2; a vector without length is at distance 1."""
    distance = F.lit(1.0) - F.coalesce(cosine_similarity(x, y), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance))
