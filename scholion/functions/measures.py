"""Measures: guarded ratios, scores and filtered aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def count_where(condition: Column) -> Column:
    """A4."""
    return F.count(F.when(condition, 1))


def distinct_where(value: Column | str, condition: Column) -> Column:
    """A3: distinct values among the rows that fit."""
    return F.count_distinct(F.when(condition, col(value)))


def least_where(value: Column | str, condition: Column) -> Column:
    """A5: the smallest value among the rows that fit: one cell of a pivoted property table."""
    return F.min(F.when(condition, col(value)))


def share(part: Column | str, whole: Column | str) -> Column:
    """Percentage; null if the whole is zero or null."""
    whole = col(whole).cast("double")
    return F.when(whole != 0, 100 * col(part).cast("double") / whole)


def z_score(x: Column | str, mean: Column | str, deviation: Column | str) -> Column:
    """Null without a deviation."""
    d = col(deviation)
    return F.when(d != 0, (col(x) - col(mean)) / d)


def outlier_ratio(x: Column | str, mad: Column | str) -> Column:
    """Distance of the value from the deviation in units of it, 1 standing for a deviation of zero."""
    m = col(mad)
    return F.abs(col(x) - m) / F.when(m == 0, 1.0).otherwise(m)


def median(x: Column | str) -> Column:
    """Exact, halfway between the middle values of an even count."""
    return F.percentile(col(x), 0.5)
