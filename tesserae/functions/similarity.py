"""Set and vector similarities as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _guard(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), value).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return _guard(a, b, shared(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def symmetric(a: Column, b: Column) -> Column:
    """The larger of the two shares of common tokens."""
    return _guard(a, b, shared(a, b) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))


def causal_overlap(a: Column, b: Column) -> Column:
    return _guard(a, b, shared(a, b) / F.greatest(F.size(a), F.size(b), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or unequally long vectors, zero norms and non-finite results."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    got = F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), F.try_divide(dot(a, b), norm))
    return F.when(got.isNull() | F.isnan(got) | (F.abs(got) == float("inf")), 0.0).otherwise(got)


def sets_equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)
