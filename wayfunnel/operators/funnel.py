"""CTR / CVR funnels by slot, variant, version and day.

Every side is aggregated to its join key before a join, so hot items and hot
requests are reduced on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions import events as ev
from wayfunnel.functions.common import ratio, scalar, with_defaults, zero
from wayfunnel.operators.attribution import (CONTEXT, attach_context, fill_slots, first_per_request_item,
                                             standard_context)
from wayfunnel.operators.relational import pick, top_overall

def rows() -> Column:
    return F.count(F.lit(1))


# Grouping columns of the daily report, nulls kept as their own group.
REPORT_KEYS = ("request_id", "dataset_id", "algorithm_version", "endpoint", "variant", "experiment_variant",
               "degrade_reason", "model_run_id", "feature_snapshot_id")

# Defaults of the training-sample context.
SAMPLE_DEFAULTS = {"endpoint": "unknown", "variant": "primary", "experiment_variant": "control",
                   "degrade_reason": "none", "source": "unknown", "device_type": "unknown",
                   "locale": "unknown", "client_app": ""}


def _counted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias(name))


def slot_metrics(exposures: DataFrame, clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    """Exposures, clicks, conversions and revenue per (item, slot), exposure driven."""
    keys = ["dataset_id", "position"]
    exposures = exposures.withColumn("position", F.coalesce("position", F.lit(-1)).cast("int"))
    slots = pick(exposures.select("request_id", "dataset_id", "position"), ["request_id", "dataset_id"],
                 [F.col("position")])
    shown = _counted(exposures, keys, "exposure_count")
    clicked = _counted(fill_slots(clicks.select("request_id", "dataset_id", "position"), slots), keys, "click_count")
    converted = fill_slots(conversions.select("request_id", "dataset_id", "position", "revenue"), slots) \
        .groupBy(*keys).agg(rows().alias("conversion_count"), F.sum("revenue").alias("conversion_revenue"))
    joined = shown.join(clicked, keys, "left").join(converted, keys, "left")
    return joined.select(
        *keys, "exposure_count", zero("click_count", "long").alias("click_count"),
        zero("conversion_count", "long").alias("conversion_count"),
        zero("conversion_revenue").alias("conversion_revenue"),
        ratio(zero("click_count"), "exposure_count").alias("ctr"),
        ratio(zero("conversion_count"), "exposure_count").alias("cvr"))


def variant_metrics(exposures: DataFrame, clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    """Counts and CTR per item, variant, endpoint, page and algorithm version."""
    keys = ["dataset_id", *CONTEXT]
    shown = _counted(standard_context(exposures.select(*keys)), keys, "exposure_count")

    def attributed(df: DataFrame, name: str) -> DataFrame:
        per_pair = df.groupBy("request_id", "dataset_id").agg(rows().alias("_n"))
        ctx = standard_context(attach_context(per_pair, exposures))
        return ctx.groupBy(*keys).agg(F.sum("_n").alias(name))

    joined = shown.join(attributed(clicks, "click_count"), keys, "left") \
        .join(attributed(conversions, "conversion_count"), keys, "left")
    return joined.select(
        *keys, "exposure_count", zero("click_count", "long").alias("click_count"),
        zero("conversion_count", "long").alias("conversion_count"),
        ratio(zero("click_count"), "exposure_count").alias("ctr"))


def aggregate_events(exposures: DataFrame, clicks: DataFrame, conversions: DataFrame) -> dict[str, DataFrame]:
    """Job: first events per (request, item), filled slots, slot and variant tables."""
    exposures = first_per_request_item(exposures, "timestamp", "event_id")
    clicks = fill_slots(first_per_request_item(clicks, "server_time", "event_id"), exposures)
    conversions = fill_slots(first_per_request_item(conversions, "server_time", "event_id"), exposures)
    return {
        "recommend_exposures": exposures,
        "recommend_clicks": clicks,
        "recommend_conversions": conversions,
        "recommend_slot_metrics": slot_metrics(exposures, clicks, conversions),
        "recommend_variant_metrics": variant_metrics(exposures, clicks, conversions),
    }


def request_metrics(exposures: DataFrame, clicks: DataFrame, conversions: DataFrame,
                    keys: Sequence[str] = ("request_id", "dataset_id", "algorithm_version"),
                    conversions_by_request: bool = False) -> DataFrame:
    """Exposures per (request, item, …) with their clicks and the item's conversions.

    As in the source metric, conversions join by item only, so one conversion is
    credited to every request that showed the item. ``conversions_by_request``
    credits a conversion only to its own request.
    """
    base = exposures.filter("request_id is not null and dataset_id is not null")
    if list(keys) == ["request_id", "dataset_id", "algorithm_version"]:
        base = base.withColumn("algorithm_version", F.coalesce("algorithm_version", F.lit("unknown")))
    shown = base.groupBy(*keys).agg(
        rows().alias("exposure_count"), F.min("timestamp").alias("first_timestamp"),
        F.avg("score").alias("avg_score"), F.min("position").alias("min_position"))
    clicked = clicks.filter("request_id is not null and dataset_id is not null and server_time is not null") \
        .groupBy("request_id", "dataset_id").agg(rows().alias("click_count"), F.min("server_time").alias("click_time"))
    on = ["request_id", "dataset_id"] if conversions_by_request else ["dataset_id"]
    converted = conversions.groupBy(*on).agg(rows().alias("conversion_count"), F.sum("revenue").alias("total_revenue"))
    joined = shown.join(clicked, ["request_id", "dataset_id"], "left").join(converted, on, "left")
    return joined.withColumns({
        "click_count": zero("click_count", "long"),
        "conversion_count": zero("conversion_count", "long"),
        "total_revenue": zero("total_revenue")})


def _rates(shown: str, clicked: str, converted: str | None = None) -> list[Column]:
    out = [ratio(clicked, shown).alias("ctr")]
    if converted:
        out.append(ratio(converted, shown).alias("cvr"))
    return out


def by_version(merged: DataFrame) -> DataFrame:
    totals = merged.groupBy("algorithm_version").agg(
        F.sum("exposure_count").alias("exposures"), F.sum("click_count").alias("clicks"),
        F.sum("conversion_count").alias("conversions"), F.sum("total_revenue").alias("revenue"))
    return totals.select("*", *_rates("exposures", "clicks", "conversions"))


def by_first_slot(merged: DataFrame) -> DataFrame:
    totals = merged.groupBy("min_position").agg(
        F.sum("exposure_count").alias("exposures"), F.sum("click_count").alias("clicks"))
    return totals.select("*", *_rates("exposures", "clicks"))


def overall_summary(merged: DataFrame, exposures: DataFrame, clicks: DataFrame) -> DataFrame:
    valid = exposures.filter("request_id is not null and dataset_id is not null")
    people = scalar(valid, requests=F.count_distinct("request_id"), users=F.count_distinct("user_id"),
                    items=F.count_distinct("dataset_id"))
    clicked = scalar(clicks.filter("request_id is not null and dataset_id is not null and server_time is not null"),
                     items=F.count_distinct("dataset_id"))
    totals = merged.agg(
        zero(F.sum("exposure_count"), "long").alias("total_exposures"),
        zero(F.sum("click_count"), "long").alias("total_clicks"),
        zero(F.sum("conversion_count"), "long").alias("total_conversions"),
        zero(F.sum("total_revenue")).alias("total_revenue"))
    return totals.select(
        "*", ratio("total_clicks", "total_exposures").alias("overall_ctr"),
        ratio("total_conversions", "total_exposures").alias("overall_cvr"),
        people["requests"].alias("unique_request_ids"), people["users"].alias("unique_users"),
        people["items"].alias("unique_datasets_exposed"), clicked["items"].alias("unique_datasets_clicked"))


def proportional_version_metrics(exposures: DataFrame, actions: DataFrame, conversions: DataFrame) -> DataFrame:
    """Item clicks and conversions shared over versions by their exposure share."""
    shown = exposures.filter("dataset_id is not null") \
        .withColumn("algorithm_version", F.coalesce("algorithm_version", F.lit("unknown")))
    start = shown.agg(F.min("timestamp").alias("t")).scalar()

    def later(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(F.col("server_time").isNotNull() & (start.isNull() | (F.col("server_time") >= start)))
        return kept.groupBy("dataset_id").agg(rows().alias(name))

    per = shown.groupBy("algorithm_version", "dataset_id").agg(rows().alias("n"))
    of_item = per.groupBy("dataset_id").agg(F.sum("n").alias("item_total"))
    share = per.join(of_item, "dataset_id").join(later(actions, "c"), "dataset_id", "left") \
        .join(later(conversions, "v"), "dataset_id", "left")
    part = F.col("n") / F.col("item_total")
    totals = share.groupBy("algorithm_version").agg(
        F.sum("n").alias("exposures"), F.sum(zero("c") * part).alias("clicks"),
        F.sum(zero("v") * part).alias("conversions"))
    return totals.select("*", *_rates("exposures", "clicks", "conversions"))


def item_report(views: DataFrame, conversions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Views and conversions per item (either may be absent) with item metadata."""
    joined = views.join(conversions, "dataset_id", "full").join(metadata, "dataset_id", "left")
    return joined.withColumns({
        "views": zero("views", "long"), "conversions": zero("conversions", "long"), "revenue": zero("revenue"),
        "conversion_rate": ratio(zero("conversions"), zero("views"))})


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_distinct("dataset_id").alias("total_datasets_tracked"), F.sum("views").alias("total_views"),
        F.sum("conversions").alias("total_conversions"), F.sum("revenue").alias("total_revenue"),
        F.avg("conversion_rate").alias("average_conversion_rate"))


def daily_base(exposures: DataFrame, clicks: DataFrame, conversions: DataFrame, views: DataFrame) -> DataFrame:
    """Funnel rows of every day at once: exposures by context, with the day's clicks,
    conversions and detail views of the item."""
    def day(df: DataFrame, c: str) -> DataFrame:
        return df.filter(F.col(c).isNotNull()).withColumn("day", F.to_date(c))

    e, k = day(exposures, "timestamp"), day(clicks, "server_time")
    c, v = day(conversions, "server_time"), day(views, "server_time")
    shown = e.filter("request_id is not null and dataset_id is not null").groupBy("day", *REPORT_KEYS).agg(
        rows().alias("exposure_count"), F.min("timestamp").alias("first_timestamp"),
        F.avg("score").alias("avg_score"), F.min("position").alias("min_position"))
    clicked = k.filter("request_id is not null and dataset_id is not null") \
        .groupBy("day", "request_id", "dataset_id").agg(rows().alias("click_count"))
    converted = c.groupBy("day", "dataset_id").agg(
        rows().alias("conversion_count"), F.sum("revenue").alias("total_revenue"))
    viewed = v.groupBy("day", "dataset_id").agg(rows().alias("detail_views"))
    joined = shown.join(clicked, ["day", "request_id", "dataset_id"], "left") \
        .join(converted, ["day", "dataset_id"], "left").join(viewed, ["day", "dataset_id"], "left")
    return joined.withColumns({
        "click_count": zero("click_count", "long"), "conversion_count": zero("conversion_count", "long"),
        "total_revenue": zero("total_revenue"), "detail_views": zero("detail_views", "long")})


def _breakdown_sums() -> list[Column]:
    return [F.sum("exposure_count").alias("exposures"), F.sum("click_count").alias("clicks"),
            F.sum("detail_views").alias("detail_views"), F.sum("conversion_count").alias("conversions"),
            F.sum("total_revenue").alias("revenue")]


def breakdowns(base: DataFrame, dimensions: Sequence[str], extra_keys: Sequence[str] = ("day",)) -> DataFrame:
    """One pass over the base for all one-column breakdowns (grouping sets)."""
    keys = list(extra_keys)
    sets = [[F.col(k) for k in keys] + [F.col(d)] for d in dimensions]
    cols = [*keys, *dimensions]
    grouped = base.groupingSets(sets, *cols).agg(F.grouping_id(*cols).alias("_gid"), *_breakdown_sums())
    label, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        # grouping_id has a 1 bit for every column that is not in the set
        gid = sum(1 << (len(dimensions) - 1 - j) for j in range(len(dimensions)) if j != i)
        label = F.when(F.col("_gid") == gid, d).otherwise(label)
        value = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(value)
    return grouped.select(
        *keys, label.alias("dimension"), value.alias("value"), "exposures", "clicks", "detail_views",
        "conversions", "revenue", ratio("clicks", "exposures").alias("ctr"),
        ratio("detail_views", "clicks").alias("detail_rate"), ratio("conversions", "exposures").alias("cvr"))


def top_items(base: DataFrame, k: int = 10) -> DataFrame:
    totals = base.groupBy("dataset_id").agg(*_breakdown_sums())
    ranked = top_overall(totals, [F.desc("clicks"), F.desc("exposures"), F.asc("dataset_id")], k)
    return ranked.select("*", ratio("clicks", "exposures").alias("ctr"),
                         ratio("detail_views", "clicks").alias("detail_rate"),
                         ratio("conversions", "exposures").alias("cvr"))


def operations(base: DataFrame) -> DataFrame:
    """Fallback share per day and the step rates of the funnel."""
    degraded = F.col("degrade_reason").isNotNull()
    totals = base.groupBy("day").agg(
        F.sum("exposure_count").alias("exposures"), F.sum("click_count").alias("clicks"),
        F.sum("conversion_count").alias("conversions"),
        F.sum(F.when(degraded, F.col("exposure_count")).otherwise(0)).alias("fallback_exposures"))
    return totals.select("*", ratio("fallback_exposures", "exposures").alias("fallback_ratio"),
                         ratio("clicks", "exposures").alias("ctr"))


DAILY_METRICS = ("total_exposures", "total_clicks", "total_conversions", "overall_ctr", "overall_cvr")


def daily_summary(base: DataFrame, views: DataFrame) -> DataFrame:
    viewed = views.filter("server_time is not null").groupBy(F.to_date("server_time").alias("day")) \
        .agg(rows().alias("total_detail_views"))
    totals = base.groupBy("day").agg(
        F.sum("exposure_count").alias("total_exposures"), F.sum("click_count").alias("total_clicks"),
        F.sum("conversion_count").alias("total_conversions"), F.sum("total_revenue").alias("total_revenue"))
    return totals.join(viewed, "day", "left").select(
        "day", "total_exposures", "total_clicks", "total_conversions", "total_revenue",
        zero("total_detail_views", "long").alias("total_detail_views"),
        ratio("total_clicks", "total_exposures").alias("overall_ctr"),
        ratio("total_conversions", "total_exposures").alias("overall_cvr"),
        ratio(zero("total_detail_views"), "total_clicks").alias("overall_detail_rate"),
        ratio("total_conversions", zero("total_detail_views")).alias("overall_detail_to_conversion_rate"))


def _relative(now: Column, base: Column) -> Column:
    return F.when(base.isNotNull() & (base != 0), F.round((now - base) / base, 4))


def deltas(summary: DataFrame, days: int = 7) -> DataFrame:
    """Change against the newest earlier day and the average of the reported days among the
    last seven. ``summary`` has one row per day, so the ordered window stays small."""
    number = F.unix_date("day")
    back = Window.orderBy(number).rangeBetween(-days, -1)
    out = summary
    for m in DAILY_METRICS:
        last = F.last(m).over(back)
        mean = F.avg(m).over(back)
        out = out.withColumn(f"{m}_vs_previous", _relative(F.col(m), last)) \
                 .withColumn(f"{m}_vs_average", _relative(F.col(m), mean))
    return out.select("day", *[f"{m}_{s}" for m in DAILY_METRICS for s in ("vs_previous", "vs_average")])


def trailing_series(summary: DataFrame, previous: int = 6, lookback: int = 7) -> DataFrame:
    """For each report day: the day and up to ``previous`` earlier reported days of the last week."""
    points = summary.select(F.col("day").alias("report_day"))
    pairs = points.withColumn("day", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(lookback)), lambda i: F.date_sub(F.col("report_day"), i)))).join(summary, "day")
    w = Window.partitionBy("report_day").orderBy(F.desc("day"))
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= previous + 1).drop("_n")


def reconciliation(orders: DataFrame, actions: DataFrame, visits: DataFrame, start: str, end: str) -> DataFrame:
    """Orders and revenue against logged actions and visits for every calendar day."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")

    def day(c: str) -> Column:
        return F.to_date(c).alias("day")

    business = orders.groupBy(day("create_time")).agg(
        F.count("dataset_id").alias("o"), F.sum(zero("price")).alias("r")).filter(F.col("day").between(first, last))
    logged = actions.groupBy(day("server_time")).agg(
        F.count("idlink_va").alias("a"), F.count_distinct("idvisit").alias("u")) \
        .filter(F.col("day").between(first, last))
    visited = visits.groupBy(day("visit_last_action_time")).agg(F.count_distinct("idvisit").alias("t")) \
        .filter(F.col("day").between(first, last))
    days = orders.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    joined = days.join(business, "day", "left").join(logged, "day", "left").join(visited, "day", "left")
    return joined.select(
        "day", zero("o", "long").alias("business_order_count"),
        F.round(zero("r"), 2).alias("business_revenue"), zero("a", "long").alias("matomo_exposures"),
        zero("u", "long").alias("matomo_unique_visits"),
        F.when(F.col("a").isNotNull(), zero("t", "long")).otherwise(F.lit(0).cast("long")).alias("matomo_total_visits"),
        F.when(zero("o") > 0, F.round(zero("a") / F.col("o"), 2)).alias("exposure_to_order_ratio"))


def training_samples(exposures: DataFrame, clicks: DataFrame) -> DataFrame:
    """Exposures with the first click as label, channel and logged channel weight."""
    shown = first_per_request_item(exposures.filter("request_id is not null and dataset_id is not null"),
                                   "timestamp", "event_id")
    clicked = clicks.filter("request_id is not null and dataset_id is not null") \
        .groupBy("request_id", "dataset_id").agg(F.min("server_time").alias("clicked_at"))
    out = shown.join(clicked, ["request_id", "dataset_id"], "left") \
        .withColumn("label", F.col("clicked_at").isNotNull().cast("int")) \
        .withColumn("reason", F.coalesce("reason", F.lit(""))) \
        .withColumn("channel", ev.channel_first("reason"))
    out = out.withColumn("channel_weight", ev.channel_weight("channel_weights", "channel"))
    return with_defaults(out, SAMPLE_DEFAULTS).withColumns({
        "score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
        "position": F.coalesce(F.col("position").cast("int"), F.lit(-1))})


def item_labels(samples: DataFrame, conversions: DataFrame) -> DataFrame:
    """Label, clicks, exposures and conversions per item."""
    counted = samples.groupBy("dataset_id").agg(
        F.max("label").alias("label"), F.sum("label").alias("click_count"), F.count("label").alias("exposure_count"))
    converted = conversions.filter("dataset_id is not null").groupBy("dataset_id").agg(
        rows().alias("conversion_count"), F.sum(zero("revenue")).alias("conversion_revenue"))
    return counted.join(converted, "dataset_id", "left").select(
        "dataset_id", "label", "click_count", "exposure_count",
        zero("conversion_count", "long").alias("conversion_count"),
        zero("conversion_revenue").alias("conversion_revenue"),
        ratio(zero("conversion_count"), "exposure_count").alias("conversion_rate"))


def slot_rollup(slots: DataFrame) -> DataFrame:
    """Slot metrics of an item rolled up; slot 1 and slots up to 3 are averaged apart."""
    first, early = F.col("position") == 1, F.col("position") <= 3

    def mean_where(cond: Column, c: str) -> Column:
        return zero(F.avg(F.when(cond, F.col(c))))

    return slots.groupBy("dataset_id").agg(
        zero(F.sum("exposure_count")).alias("slot_total_exposures"),
        zero(F.sum("click_count")).alias("slot_total_clicks"),
        zero(F.sum("conversion_count")).alias("slot_total_conversions"),
        zero(F.sum("conversion_revenue")).alias("slot_total_revenue"),
        zero(F.avg("ctr")).alias("slot_mean_ctr"), zero(F.max("ctr")).alias("slot_max_ctr"),
        zero(F.avg("cvr")).alias("slot_mean_cvr"),
        F.count_distinct("position").cast("double").alias("slot_position_coverage"),
        mean_where(first, "ctr").alias("slot_ctr_top1"), mean_where(early, "ctr").alias("slot_ctr_top3"),
        mean_where(first, "cvr").alias("slot_cvr_top1"), mean_where(early, "cvr").alias("slot_cvr_top3"))


def fallback_share(exposures: DataFrame) -> DataFrame:
    per = exposures.groupBy(F.coalesce("endpoint", F.lit("unknown")).alias("endpoint")).agg(
        rows().alias("exposures"), F.count_if(F.col("degrade_reason").isNotNull()).alias("fallback_exposures"))
    return per.select("*", ratio("fallback_exposures", "exposures").alias("fallback_ratio"))
