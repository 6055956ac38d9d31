"""Array-vector arithmetic on built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfunnel.functions.common import ColumnLike, col


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: ColumnLike) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def mean(a: ColumnLike) -> Column:
    return F.when(F.size(col(a)) > 0, _sum(col(a)) / F.size(col(a)))


def population_std(a: ColumnLike) -> Column:
    m = mean(a)
    squares = F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))
    variance = _sum(squares) / F.size(col(a)) - m * m
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def normalised(a: ColumnLike) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(col(a), lambda x: x.cast("double") / length)).otherwise(
        F.transform(col(a), lambda x: F.lit(0.0)))
