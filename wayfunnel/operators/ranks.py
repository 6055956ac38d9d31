"""Global ranks, exact quantiles and concentration without a one-task window.

A global ``row_number`` or ``percentile`` sends every row to one task. Here rows
are first reduced to a histogram (value, count), the histogram is cut into value
ranges by approximate quantiles, ranks are counted inside each range, and range
totals (a row for each range) supply the offsets. There are as many ranges as the
number of rows asks for. Results are exact: the approximate cuts only decide which
task counts which value.

Single quantiles are selected without ranking anything else: a sketch brackets each
wanted rank, one pass counts what lies below and inside each bracket, and brackets
are narrowed until few rows are inside; only these are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000   # about so many rows fall into one range
ACCURACY = 10_000        # of the sketch that brackets a rank: off by one in so many rows at most
FEW_ROWS = 100_000       # a bracket with no more rows is sorted


def range_steps(rows: int) -> int:
    """Ranges are found in two steps of so many each, so their number is the square of this."""
    return max(4, math.ceil(math.sqrt(rows / RANGE_ROWS)))


def with_range(df: DataFrame, source: DataFrame, column: str, key: str) -> DataFrame:
    """Number of the value range of ``key``; cuts are approximate quantiles of ``source[column]``."""
    steps = range_steps(source.count())
    ranges = steps * steps
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = source.agg(F.percentile_approx(F.col(column).cast("double"), cuts, 16 * ranges).alias("b")).scalar()
    cut = df.withColumn("_bounds", F.coalesce(bounds, F.array().cast("array<double>")))
    below = lambda b: b < F.col(key)
    coarse = F.size(F.filter(F.filter("_bounds", lambda b, i: i % steps == steps - 1), below))
    fine = F.size(F.filter(F.slice("_bounds", F.col("_coarse") * steps + 1, F.lit(steps - 1)), below))
    return cut.withColumn("_coarse", coarse).withColumn("_range", F.col("_coarse") * steps + fine).drop("_bounds", "_coarse")


def ranked_values(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with ``n`` (rows), ``below`` (rows less), ``distinct_below``,
    ``sum_below`` and the grand totals ``total``, ``distinct_total``, ``sum_total``."""
    values = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    hist = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    hist = with_range(hist, values, "v", "v")
    totals = hist.groupBy("_range").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"),
                                        F.sum(F.col("v") * F.col("n")).alias("_s"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_d").over(ahead), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_s0"),
        F.sum("_n").over(whole).alias("total"),
        F.sum("_d").over(whole).alias("distinct_total"),
        F.sum("_s").over(whole).alias("sum_total"))
    inside = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    counted = hist.select(
        "v", "n", "_range",
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_below"),
        F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)).alias("_dbelow"),
        F.coalesce(F.sum(F.col("v") * F.col("n")).over(inside), F.lit(0.0)).alias("_sbelow"))
    return counted.join(F.broadcast(offsets), "_range").select(
        F.col("v").alias(value), "n",
        (F.col("_below") + F.col("_n0")).alias("below"),
        (F.col("_dbelow") + F.col("_d0")).alias("distinct_below"),
        (F.col("_sbelow") + F.col("_s0")).alias("sum_below"),
        "total", "distinct_total", "sum_total")


def with_position(df: DataFrame, value: str, tie: str, out: str, descending: bool = True) -> DataFrame:
    """1-based position by the numeric ``value``, then ``tie``, counted range by range."""
    order = F.desc if descending else F.asc
    ranged = with_range(df, df, value, value)
    per = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)  # few ranges
    offset = per.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_range").orderBy(order(value), F.asc(tie))
    return ranged.withColumn("_p", F.row_number().over(inside)).join(F.broadcast(offset), "_range") \
        .withColumn(out, (F.col("_p") + F.col("_o")).cast("long")).drop("_p", "_o", "_range")


def with_dense_rank(df: DataFrame, value: str, out: str, pct: str | None = None) -> DataFrame:
    """Descending dense rank, and optionally the average-rank percentile (ascending)."""
    ranks = ranked_values(df, value)
    columns = [F.col(value).alias("_key"),
               (F.col("distinct_total") - F.col("distinct_below")).alias(out)]
    if pct:
        columns.append(((F.col("below") + (F.col("n") + 1) / 2.0) / F.col("total")).alias(pct))
    return df.join(ranks.select(*columns), df[value].cast("double") == F.col("_key"), "left").drop("_key")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    ranks = ranked_values(df, value).select(F.col(value).alias("_key"),
                                            (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, df[value].cast("double") == F.col("_key"), "left").drop("_key")


def selected(df: DataFrame, value: str, ranks: Sequence[int], total: int) -> dict[int, float]:
    """The values at some 0-based ranks in ascending order among the ``total`` non-null ones.

    The driver holds two bounds and two counts for each rank; every round is one pass with partial sums.
    """
    v = F.col("v")
    values = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    brackets: dict[int, tuple] = dict.fromkeys(ranks, (None, None))
    below, inside = dict.fromkeys(ranks, 0), dict.fromkeys(ranks, total)

    def within(rank: int) -> Column:
        lo, hi = brackets[rank]
        return (v >= F.lit(lo)) & (v <= F.lit(hi)) if lo is not None else F.lit(True)

    while True:
        wide = [r for r in ranks if inside[r] > FEW_ROWS and (brackets[r][0] is None or brackets[r][0] != brackets[r][1])]
        if not wide:
            break
        cuts = {r: [min(1.0, max(0.0, (r - below[r]) / inside[r] + e)) for e in (-2 / ACCURACY, 2 / ACCURACY)] for r in wide}
        row = values.agg(*[F.percentile_approx(F.when(within(r), v), cuts[r], ACCURACY).alias(f"q{r}") for r in wide]).first()
        narrowed = {r: tuple(row[f"q{r}"]) for r in wide}
        if all(narrowed[r] == brackets[r] for r in wide):
            break  # the sketch can't tell them apart any further
        brackets |= narrowed
        row = values.agg(*[x for r in wide for x in (F.count_if(v < F.lit(brackets[r][0])).alias(f"b{r}"), F.count_if(within(r)).alias(f"n{r}"))]).first()
        for r in wide:
            below[r], inside[r] = row[f"b{r}"], row[f"n{r}"]
    out = {r: brackets[r][0] for r in ranks if brackets[r][0] is not None and brackets[r][0] == brackets[r][1]}
    rest = [r for r in ranks if r not in out]
    if rest:
        tagged = values.select("v", F.explode(F.filter(F.array(*[F.when(within(r), F.lit(r)) for r in rest]), lambda x: x.isNotNull())).alias("rank"))
        upto = Window.partitionBy("rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # about FEW_ROWS rows for each rank
        offsets = F.create_map(*[x for r in rest for x in (F.lit(r), F.lit(below[r]))])
        counted = tagged.groupBy("rank", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto) + offsets[F.col("rank")])
        found = counted.filter(F.col("upto") > F.col("rank")).groupBy("rank").agg(F.min("v").alias("v"))
        out |= {r["rank"]: r["v"] for r in found.collect()}
    return out


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles as one row, one column per name; nulls without any value."""
    total = df.filter(F.col(value).isNotNull()).count()
    row: dict[str, float | None] = dict.fromkeys(probs)
    if total:
        places = {name: float(p) * (total - 1) for name, p in probs.items()}
        found = selected(df, value, sorted({int(f(x)) for x in places.values() for f in (math.floor, math.ceil)}), total)
        for name, x in places.items():
            lo, hi = found[math.floor(x)], found[math.ceil(x)]
            row[name] = lo + (hi - lo) * (x - math.floor(x))
    return df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` double" for n in row))


def concentration(df: DataFrame, value: str) -> DataFrame:
    """``as_written`` = 2*sum((n-i)*x_i)/(n*sum(x)) over ascending x, and the usual Gini
    coefficient ``gini`` = 1 - 1/n - as_written."""
    r = ranked_values(df.select(F.col(value).alias("value")), "value")
    v, n, below, total = F.col("value"), F.col("n"), F.col("below"), F.col("total")
    weighted = F.sum(v * (n * total - n * below - n * (n + 1) / 2.0))
    row = r.agg(weighted.alias("w"), F.max("total").alias("t"), F.sum(v * n).alias("s"))
    as_written = F.when((F.col("s") != 0) & F.col("t").isNotNull(),
                        2 * F.col("w") / (F.col("t") * F.col("s"))).otherwise(0.0)
    gini = F.when((F.col("s") != 0) & F.col("t").isNotNull(), 1 - 1 / F.col("t") - as_written).otherwise(0.0)
    return row.select(as_written.alias("as_written"), gini.alias("gini"))
