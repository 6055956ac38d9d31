"""Column helpers shared by all operators (null-safe ratios, casts, dates)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den as double, 0.0 where the denominator is 0 or null."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def zero(c: ColumnLike, kind: str = "double") -> Column:
    return F.coalesce(col(c).cast(kind), F.lit(0).cast(kind))


def finite(c: ColumnLike) -> Column:
    """Value as double; text that is not a number, NaN and infinities become null."""
    value = col(c).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)


def log1p_floor(c: ColumnLike) -> Column:
    return F.log1p(F.greatest(col(c), F.lit(0.0)))


def micros(ts: ColumnLike) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole days, rounded down (also for negative spans)."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def fractional_days(later: ColumnLike, earlier: ColumnLike) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def timestamp_lit(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def bucket_of(value: ColumnLike, edges: Iterable[float], right_closed: bool) -> Column:
    """Index of the bucket between ``edges``; the last bucket is open-ended.

    ``right_closed=True`` puts a value equal to an edge in the lower bucket.
    """
    v = col(value)
    expr: Column | None = None
    edges = list(edges)
    for i, edge in enumerate(edges):
        inside = (v <= edge) if right_closed else (v < edge)
        expr = F.when(inside, F.lit(i)) if expr is None else expr.when(inside, F.lit(i))
    assert expr is not None
    return F.when(v.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(len(edges)))).cast("double")


def split_tags(c: ColumnLike, lower: bool = True) -> Column:
    """`a;b; c` -> trimmed, non-empty tokens."""
    text = F.coalesce(col(c), F.lit(""))
    if lower:
        text = F.lower(text)
    return F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda t: t != "")


def fill_numeric(df: DataFrame, value: float = 0.0, skip: Iterable[str] = ()) -> DataFrame:
    """Null numeric cells -> value, leaving text and time columns alone."""
    skip = set(skip)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    return df.na.fill(value, names)


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Null (or absent) context columns -> default text."""
    present = set(df.columns)
    return df.withColumns({
        name: (F.coalesce(F.col(name).cast("string"), F.lit(value)) if name in present else F.lit(value))
        for name, value in defaults.items()
    })


def scalar(df: DataFrame, **aggregates: Column) -> Column:
    """Several global aggregates of ``df`` as one struct-valued scalar subquery.

    Spark evaluates the subquery once and feeds the single row to the main plan,
    so no cross join and no driver round trip is needed.
    """
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("stats")).scalar()
