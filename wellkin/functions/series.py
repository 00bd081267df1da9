"""Arithmetic on fixed-length monthly arrays with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def scale(values: Column, factor: Column | float) -> Column:
    return F.transform(values, lambda v: v * factor)


def log1p(values: Column) -> Column:
    return F.transform(values, lambda v: F.log1p(v))


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def weighted_mae(actual: Column, predicted: Column, weights) -> Column:
    """Weighted mean absolute error of two series; null if either series is null."""
    gaps = F.zip_with(actual, predicted, lambda a, p: F.abs(a - p))
    weighted = F.zip_with(gaps, literal(weights), lambda g, w: g * w)
    return total(weighted) / sum(weights)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """F8: cosine similarity with a small floor in the denominator; 0 when either is missing."""
    similarity = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)
    return F.when(a.isNotNull() & b.isNotNull(), similarity).otherwise(0.0)


def component_diff(a: Column, b: Column, position: int) -> Column:
    """F8: b - a at one position; 0 when either is missing."""
    gap = F.get(b, F.lit(position)) - F.get(a, F.lit(position))
    return F.when(a.isNotNull() & b.isNotNull(), gap).otherwise(0.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def per_slot(months: int, build) -> Column:
    """An array whose i-th element is the column ``build(i)``."""
    return F.array(*[build(i) for i in range(months)])
