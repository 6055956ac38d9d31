"""Outlier, duplicate, timestamp and missing-value cleaning.

Bounds come from exact distributed quantiles; picks use an explicit order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions.common import scalar
from wayfunnel.operators.ranks import quantiles, with_range
from wayfunnel.operators.relational import keep_unique_keys, outer_union, pick


def iqr_bounds(df: DataFrame, column: str, threshold: float = 3.0) -> Column:
    """Scalar struct {lower, upper} around the quartiles."""
    q = quantiles(df, column, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select(F.struct((F.col("q1") - threshold * spread).alias("lower"),
                             (F.col("q3") + threshold * spread).alias("upper")).alias("b")).scalar()


def iqr_flag(df: DataFrame, column: str, threshold: float = 3.0, out: str = "is_outlier") -> DataFrame:
    b = iqr_bounds(df, column, threshold)
    hit = (F.col(column) < b["lower"]) | (F.col(column) > b["upper"])
    return df.withColumn(out, F.coalesce(hit, F.lit(False)))


def zscore_flag(df: DataFrame, column: str, threshold: float = 3.0, out: str = "is_outlier") -> DataFrame:
    s = scalar(df, m=F.avg(column), d=F.stddev_pop(column))
    z = F.when(s["d"] > 0, F.abs(F.col(column) - s["m"]) / s["d"])
    return df.withColumn(out, F.coalesce(z > threshold, F.lit(False)))


def iqr_clip(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    b = iqr_bounds(df, column, threshold)
    clipped = F.when(F.col(column) < b["lower"], b["lower"]).when(F.col(column) > b["upper"], b["upper"])
    return df.withColumn(column, F.coalesce(clipped, F.col(column)))


def cap_percentiles(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Cap at the upper percentile, then at the lower percentile (both of the raw column)."""
    q = quantiles(df, column, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("q")).scalar()
    c = F.col(column)
    return df.withColumn(column, F.when(c > q["hi"], q["hi"]).when(c < q["lo"], q["lo"]).otherwise(c))


def outlier_stats(flagged: DataFrame, removed: bool, method: str) -> DataFrame:
    total, hits = F.count(F.lit(1)), F.count_if(F.col("is_outlier"))
    gone = hits if removed else F.lit(0).cast("long")
    return flagged.agg(F.lit(method).alias("method"), hits.alias("anomalies_found"), total.alias("original_count"),
                       (total - gone).alias("cleaned_count"), gone.alias("removed_count"))


def drop_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str) -> DataFrame:
    """keep = first | last (along ``order``) | none (drop every repeated key)."""
    if keep == "none":
        return keep_unique_keys(df, keys)
    columns = [F.col(c).asc_nulls_first() if keep == "first" else F.col(c).desc_nulls_last() for c in order]
    return pick(df, keys, columns)


def duplicate_stats(df: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    kept = F.count_if(F.col("n") == 1) if keep == "none" else F.count(F.lit(1))
    repeated = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return per.agg(F.lit(keep).alias("keep"), total.alias("original_count"), repeated.alias("duplicate_count"),
                   (total - kept).alias("removed_count"), kept.alias("cleaned_count"),
                   (repeated / total).alias("duplicate_ratio"))


def fix_timestamps(df: DataFrame, column: str, as_of: Column, max_future_days: int = 0) -> DataFrame:
    """Times after ``as_of`` become ``as_of``; rows without a time are dropped."""
    limit = F.timestamp_add("DAY", F.lit(max_future_days), as_of)
    return df.filter(F.col(column).isNotNull()) \
        .withColumn(column, F.when(F.col(column) > limit, as_of).otherwise(F.col(column)))


def timestamp_stats(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    total, nulls = F.count(F.lit(1)), F.count_if(F.col(column).isNull())
    return df.agg(total.alias("original_count"), nulls.alias("null_count"),
                  F.count_if(F.col(column) > as_of).alias("future_count"), (total - nulls).alias("cleaned_count"),
                  nulls.alias("removed_count"))


def fill_ordered(df: DataFrame, order: str, column: str, forward: bool = True) -> DataFrame:
    """Forward / back fill along a unique numeric order over the whole table.

    The order is cut into ranges; inside a range a window fills, and the last (next)
    known value of the ranges before (after) is carried on a table of at most RANGES rows.
    """
    ranged = with_range(df, df, order, order)
    edge = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))) if forward else \
        F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
    edges = ranged.groupBy("_range").agg(edge.alias("_edge"))
    if forward:
        over_ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = F.last("_edge", ignorenulls=True).over(over_ranges)
        inner = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        near = F.last(column, ignorenulls=True).over(inner)
    else:
        over_ranges = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
        carried = F.first("_edge", ignorenulls=True).over(over_ranges)
        inner = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        near = F.last(column, ignorenulls=True).over(inner)
    carry = edges.select("_range", carried.alias("_carry"))
    filled = ranged.withColumn("_near", near).join(F.broadcast(carry), "_range", "left")
    return filled.withColumn(column, F.coalesce("_near", "_carry")).drop("_range", "_near", "_carry")


def fill_missing(df: DataFrame, strategies: Mapping[str, str], order: str) -> DataFrame:
    """Per column: drop | mean | median | mode | ffill | bfill | constant:value."""
    out = df
    for column, how in strategies.items():
        if how == "drop":
            out = out.filter(F.col(column).isNotNull())
        elif how == "mean":
            out = out.withColumn(column, F.coalesce(column, scalar(out, v=F.avg(column))["v"]))
        elif how == "median":
            out = out.withColumn(column, F.coalesce(column, quantiles(out, column, {"v": 0.5}).scalar()))
        elif how == "mode":
            # most frequent value, the smallest of equally frequent ones
            counts = out.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            best = counts.orderBy(F.desc("n"), F.asc(column)).limit(1).select(column).scalar()
            out = out.withColumn(column, F.coalesce(column, best))
        elif how in ("ffill", "bfill"):
            out = fill_ordered(out, order, column, how == "ffill")
        elif how.startswith("constant:"):
            value = F.lit(how.split(":", 1)[1]).cast(out.schema[column].dataType)
            out = out.withColumn(column, F.coalesce(column, value))
        else:
            raise ValueError(f"unknown strategy {how!r}")
    return out


def missing_stats(df: DataFrame, strategies: Mapping[str, str]) -> DataFrame:
    names = list(strategies)
    counted = df.agg(F.count(F.lit(1)).alias("t"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count"),
                              (F.col(c) / F.col("t")).alias("null_ratio"),
                              F.lit(strategies[c]).alias("strategy")) for c in names])
    return counted.select(F.explode(rows).alias("r")).select("r.*").filter("null_count > 0")


def clean_interactions(df: DataFrame, as_of: Column, order: Sequence[str]) -> DataFrame:
    """Last row per pair, repaired times, no negative weights, weights clipped at 3 IQR, valid ids."""
    out = drop_duplicates(df, ["user_id", "dataset_id"], order, "last")
    out = fix_timestamps(out, "last_event_time", as_of)
    out = out.filter("weight is null or weight >= 0")
    out = iqr_clip(out, "weight", 3.0)
    return out.filter("user_id is not null and dataset_id is not null").withColumns({
        "user_id": F.col("user_id").cast("long"), "dataset_id": F.col("dataset_id").cast("long")})


def clean_items(df: DataFrame, as_of: Column, order: Sequence[str]) -> DataFrame:
    out = iqr_clip(drop_duplicates(df, ["dataset_id"], order, "first"), "price", 3.0)
    texts = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("description", "tag", "dataset_name") if c in out.columns}
    return fix_timestamps(out.withColumns(texts), "create_time", as_of)


def clean_users(df: DataFrame, order: Sequence[str]) -> DataFrame:
    out = drop_duplicates(df, ["user_id"], order, "first")
    return out.na.fill("unknown", ["province", "city", "company_name"])


def cleaning_report(tables: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows before and after per table: {name: (raw, cleaned)}."""
    parts = []
    for name, (raw, cleaned) in tables.items():
        before = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
        parts.append(cleaned.agg(F.count(F.lit(1)).alias("cleaned_count")).select(
            F.lit(name).alias("table_name"), before.alias("original_count"), "cleaned_count"))
    out = outer_union(parts)
    return out.withColumn("removed_count", F.col("original_count") - F.col("cleaned_count"))
