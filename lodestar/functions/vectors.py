"""Vector and set functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is missing, empty, of another length or of zero length."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(ok, F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0))))


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; null if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
