"""Vector expressions over arrays of doubles, interpreted by built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """V1: sum of products in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """V2: 0 where either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def unit(a: Column) -> Column:
    """A zero vector stays zero."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x.cast("double") / size))


def plus(a: Column, b: Column, factor: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + F.lit(float(factor)) * y.cast("double"))


def is_nonzero(a: Column) -> Column:
    """F9"""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def xavier(inputs: int, outputs: int, seed: int = 42) -> Column:
    """One draw of the uniform distribution that layers of these widths start from."""
    return (F.rand(seed) * 2 - 1) * F.sqrt(F.lit(6.0 / (inputs + outputs)))
