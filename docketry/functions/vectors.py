"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Length 1; a vector of zeros stays as it is."""
    norm = F.sqrt(dot(v, v))
    safe = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(v, lambda x: x.cast("double") / safe)
