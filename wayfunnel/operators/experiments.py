"""Experiment assignment, traffic allocation and channel weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions import events as ev
from wayfunnel.functions.common import scalar, zero

MAX_HASH = float(0xFFFFFFFF)

# Default fusion weights and smoothing of the weight trainer.
DEFAULT_WEIGHTS: dict[str, float] = dict(ev.LABEL_CHANNEL_WEIGHTS)
ALPHA, BETA, CTR_SHARE, CVR_SHARE, MIN_EXPOSURES = 2.0, 50.0, 0.8, 0.2, 500


def hash_share(salt: str, key: Column | str) -> Column:
    """First 8 hex digits of sha256(`salt:key`) as a share of 0..1."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), k.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / MAX_HASH


def assign_variant(key: Column | str, salt: str, variants: Sequence[tuple[str, float]], active: bool = True) -> Column:
    """First variant whose cumulative allocation reaches the key's share; no key or paused -> control."""
    k = F.col(key) if isinstance(key, str) else key
    if not active:
        return F.lit("control")
    share = hash_share(salt, k)
    expr: Column = F.when(k.isNull(), "control")
    running = 0.0
    for name, allocation in variants:
        running += allocation
        expr = expr.when(share <= running, name)
    return expr.otherwise(variants[-1][0])


def normalise_allocations(variants: DataFrame) -> DataFrame:
    """(experiment, position, variant, allocation) with allocations summing to 1; the last variant takes
    the rounding rest. An experiment has a handful of variants."""
    w = Window.partitionBy("experiment")
    share = F.col("allocation") / F.sum("allocation").over(w)
    out = variants.withColumn("share", share)
    rest = F.greatest(F.lit(0.0), 1.0 - F.sum("share").over(w))
    last = F.col("position") == F.max("position").over(w)
    return out.withColumn("share", F.col("share") + F.when(last, rest).otherwise(0.0))


def variant_totals(metrics: DataFrame, endpoint: str | None) -> DataFrame:
    kept = metrics.filter(F.col("endpoint") == endpoint) if endpoint else metrics
    return kept.groupBy("variant").agg(F.sum("exposure_count").alias("exposure_count"),
                                       F.sum("click_count").alias("click_count"))


def new_allocations(totals: DataFrame, variants: DataFrame, min_exposures: int, alpha: float, beta: float,
                    exploration: float) -> DataFrame:
    """Smoothed click rates to traffic shares with an exploration floor; unchanged when no variant has data.

    ``variants``: variant, allocation (one row per variant).
    """
    joined = variants.join(totals, "variant", "left")
    e, c = zero("exposure_count"), zero("click_count")
    scored = joined.withColumn("score", F.when(e < min_exposures, 0.0).otherwise((c + alpha) / (e + beta)))
    w = Window.partitionBy(F.lit(1))  # one row per variant
    total, n = F.sum("score").over(w), F.count(F.lit(1)).over(w)
    share = scored.withColumn("_t", total).withColumn("_n", n).withColumn(
        "_s", F.when(F.col("_t") > 0, F.col("score") / F.col("_t") * max(0.0, 1.0 - exploration) + F.lit(exploration) / F.col("_n")))
    final = F.when(F.col("_t") > 0, F.col("_s") / F.sum("_s").over(w)).otherwise(F.col("allocation"))
    return share.withColumn("new_allocation", final).select("variant", "score", "allocation", "new_allocation")


def channel_weights(exposures: DataFrame, clicks: DataFrame, conversions: DataFrame,
                    defaults: Mapping[str, float] = DEFAULT_WEIGHTS, min_exposures: int = MIN_EXPOSURES,
                    alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Channel weights from smoothed click and conversion rates, scaled to the default total;
    channels without exposures keep their default."""
    keys = ["request_id", "dataset_id"]
    shown = exposures.filter("dataset_id is not null") \
        .withColumn("channel", ev.channel_first_known("reason", defaults)).filter("channel <> 'unknown'")

    def flags(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys).distinct().withColumn(name, F.lit(1.0))

    joined = shown.join(flags(clicks, "clicked"), keys, "left").join(flags(conversions, "converted"), keys, "left")
    stats = joined.groupBy("channel").agg(F.count("dataset_id").alias("n"), F.sum(zero("clicked")).alias("c"),
                                          F.sum(zero("converted")).alias("v"))
    rate = CTR_SHARE * (F.col("c") + alpha) / (F.col("n") + beta) + CVR_SHARE * (F.col("v") + alpha) / (F.col("n") + beta)
    raw = stats.withColumn("raw", F.when(F.col("n") < min_exposures, ev.lookup("channel", defaults, 0.1)).otherwise(rate)) \
        .filter("raw > 0")
    total = scalar(raw, t=F.sum("raw"))["t"]
    scaled = raw.select("channel", F.round(F.col("raw") * sum(defaults.values()) / total, 6).alias("scaled"))
    base = exposures.sparkSession.createDataFrame(list(defaults.items()), "channel string, base double")
    return base.join(scaled, "channel", "full").select("channel", F.coalesce("scaled", F.round("base", 6)).alias("weight"))


