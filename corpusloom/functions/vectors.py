"""Vectors as arrays of numbers; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    scaled = lambda n: F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))
