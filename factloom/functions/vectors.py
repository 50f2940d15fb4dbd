"""Vectors and multisets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of two maps of counts."""
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def union_size(a: Column, b: Column) -> Column:
    """Sum of the larger counts."""
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Smaller counts over larger counts; both empty: 1, one empty: 0."""
    return F.when(union_size(a, b) == 0, 1.0).otherwise(overlap(a, b) / union_size(a, b))
