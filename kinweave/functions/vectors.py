"""Vector functions on arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector divided by its length; an error for length zero or a value that isn't finite."""
    n = norm(a)
    bad = n.isNull() | (n == 0) | F.isnan(n) | (n == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a vector has no finite length over zero")).cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def valid(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
