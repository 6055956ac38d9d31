"""Window, ranking and set building blocks used by every family.

Ordered picks always take an explicit tie-break, so a rerun after a lost
executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions.common import ColumnLike, col


def fits_broadcast(df: DataFrame, max_rows: int = 2_000_000) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key. Spark prunes each map partition to ``n`` rows per key first,
    so a key that holds most of the rows does not travel whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_overall(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; every task keeps ``k`` rows, one small merge follows."""
    return df.orderBy(*order).limit(k)


def keep_unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once (duplicates are all dropped)."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return df.join(single, list(keys), "left_semi")


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """value / sum(value) within the key, through a small pre-aggregated total."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    joined = df.join(totals, list(keys))
    return joined.withColumn(out, F.when(F.col("_total") != 0, F.col(value) / F.col("_total"))
                             .otherwise(0.0)).drop("_total")


def fill_along(df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str,
               forward: bool = True) -> Column:
    """Last (or next) non-null value along an explicit order within the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if forward:
        return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def calendar(days: DataFrame, column: str) -> DataFrame:
    """Every day between the first and the last date of ``column``: one row per day."""
    bounds = days.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo is not null")
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias(column))


def outer_union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def distinct_values(frames: Sequence[tuple[DataFrame, ColumnLike]], name: str) -> DataFrame:
    """Distinct union of one column taken from several tables."""
    out: DataFrame | None = None
    for frame, c in frames:
        part = frame.select(col(c).alias(name)).distinct()
        out = part if out is None else out.union(part)
    assert out is not None
    return out.filter(F.col(name).isNotNull()).distinct()
