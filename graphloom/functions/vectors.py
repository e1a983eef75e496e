"""Reductions of vector columns, as column expressions over doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def mean(c: Column) -> Column:
    return F.try_divide(total(c), F.size(c).cast("double"))


def median(c: Column) -> Column:
    """The middle component, or the mean of the two middle ones."""
    ordered, n = F.array_sort(c), F.size(c)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def deviation(c: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.try_divide(F.aggregate(F.transform(c, lambda x: x - mean(c)), F.lit(0.0), lambda a, x: a + x * x), F.size(c).cast("double")))


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def smallest(c: Column) -> Column:
    """Minimum component; as comparisons with NaN are false, a NaN does not count unless it comes first."""
    return F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), lambda a, x: F.when(~F.isnan(x) & (x < a), x).otherwise(a))


def largest(c: Column) -> Column:
    return F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), lambda a, x: F.when(~F.isnan(x) & (x > a), x).otherwise(a))


REDUCTIONS = {"min": smallest, "max": largest, "avg": mean, "median": median, "std": deviation, "abs": norm}
