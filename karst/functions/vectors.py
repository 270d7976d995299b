"""Similarities of array<float> columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.try_divide(dot(a, b), norm))


def euclidean(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def literal(v: list[float]) -> Column:
    """v as an array of floats, as stored vectors are."""
    return F.array(*[F.lit(float(x)).cast("float") for x in v])
