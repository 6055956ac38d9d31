"""Queries for funnel and effectiveness metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import Inputs
from wayfunnel.functions.text import stamp
from wayfunnel.operators import attribution as at
from wayfunnel.operators import funnel as fn
from wayfunnel.plans import events as pe
from wayfunnel.plans.oracle import DIV, I, R, TABLES, TS
from wayfunnel.plans.registry import query

DIMENSIONS = ("algorithm_version", "endpoint", "min_position")


def first_events(t: Inputs) -> dict[str, DataFrame]:
    return fn.aggregate_events(t.exposures, t.clicks, t.conversions)


TABLES["x_slot_metrics"] = f"""
  SELECT e.dataset_id, e.position, e.n AS exposure_count, coalesce(c.n, 0) AS click_count,
         coalesce(v.n, 0) AS conversion_count, coalesce(v.r, 0.0) AS conversion_revenue,
         {DIV('coalesce(c.n, 0)', 'e.n')} AS ctr, {DIV('coalesce(v.n, 0)', 'e.n')} AS cvr
  FROM (SELECT dataset_id, position, count(*) AS n FROM x_first_exposures GROUP BY 1, 2) e
  LEFT JOIN (SELECT dataset_id, position, count(*) AS n FROM x_slotted_clicks GROUP BY 1, 2) c
    ON e.dataset_id = c.dataset_id AND e.position = c.position
  LEFT JOIN (SELECT dataset_id, position, count(*) AS n, sum(revenue) AS r FROM x_slotted_conversions GROUP BY 1, 2) v
    ON e.dataset_id = v.dataset_id AND e.position = v.position"""

_SLOT_SQL = f"""
  SELECT dataset_id, {I('position')} AS position, exposure_count, click_count, conversion_count,
         {R('conversion_revenue')} AS conversion_revenue, {R('ctr')} AS ctr, {R('cvr')} AS cvr FROM x_slot_metrics"""


@query("fun1_slot_metrics", _SLOT_SQL)
def _(t: Inputs) -> DataFrame:
    return first_events(t)["recommend_slot_metrics"]


def _std(alias: str) -> str:
    return ", ".join(f"coalesce({alias}{c}, '{d}') AS {c}" for c, d in at.CONTEXT_DEFAULTS.items())


TABLES["x_pair_context"] = """
  SELECT DISTINCT request_id, dataset_id, variant, endpoint, page_id, algorithm_version FROM x_first_exposures"""
TABLES["x_variant_metrics"] = f"""
  SELECT e.*, coalesce(c.n, 0) AS click_count, coalesce(v.n, 0) AS conversion_count,
         {DIV('coalesce(c.n, 0)', 'e.exposure_count')} AS ctr
  FROM (SELECT dataset_id, {_std('')}, count(*) AS exposure_count FROM x_first_exposures GROUP BY ALL) e
  LEFT JOIN (SELECT c.dataset_id, {_std('x.')}, count(*) AS n FROM x_slotted_clicks c
             LEFT JOIN x_pair_context x USING (request_id, dataset_id) GROUP BY ALL) c
    USING (dataset_id, variant, endpoint, page_id, algorithm_version)
  LEFT JOIN (SELECT c.dataset_id, {_std('x.')}, count(*) AS n FROM x_slotted_conversions c
             LEFT JOIN x_pair_context x USING (request_id, dataset_id) GROUP BY ALL) v
    USING (dataset_id, variant, endpoint, page_id, algorithm_version)"""


@query("fun2_variant_metrics", f"""
  SELECT dataset_id, variant, endpoint, page_id, algorithm_version, exposure_count, click_count, conversion_count,
         {R('ctr')} AS ctr FROM x_variant_metrics""")
def _(t: Inputs) -> DataFrame:
    return first_events(t)["recommend_variant_metrics"]


@query("fun3_aggregate_events", """
  SELECT 'recommend_exposures' AS table_name, count(*) AS row_count FROM x_first_exposures
  UNION ALL SELECT 'recommend_clicks', count(*) FROM x_slotted_clicks
  UNION ALL SELECT 'recommend_conversions', count(*) FROM x_slotted_conversions
  UNION ALL SELECT 'recommend_slot_metrics', count(*) FROM x_slot_metrics
  UNION ALL SELECT 'recommend_variant_metrics', count(*) FROM x_variant_metrics""")
def _(t: Inputs) -> DataFrame:
    """Row counts of the five tables the aggregation job produces."""
    parts = [df.agg(fn.rows().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in first_events(t).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


TABLES["x_request_metrics"] = """
  SELECT e.*, coalesce(c.n, 0) AS click_count, c.t AS click_time, coalesce(v.n, 0) AS conversion_count,
         coalesce(v.r, 0.0) AS total_revenue
  FROM (SELECT request_id, dataset_id, coalesce(algorithm_version, 'unknown') AS algorithm_version,
               count(*) AS exposure_count, min(timestamp) AS first_timestamp, avg(score) AS avg_score,
               min(position) AS min_position FROM x_exposures GROUP BY 1, 2, 3) e
  LEFT JOIN (SELECT request_id, dataset_id, count(*) AS n, min(server_time) AS t FROM x_clicks GROUP BY 1, 2) c
    USING (request_id, dataset_id)
  LEFT JOIN (SELECT dataset_id, count(*) AS n, sum(revenue) AS r FROM x_conversions GROUP BY 1) v USING (dataset_id)"""


@query("fun4_request_metrics", f"""
  SELECT request_id, dataset_id, algorithm_version, exposure_count, {TS('first_timestamp')} AS first_timestamp,
         {R('avg_score')} AS avg_score, {I('min_position')} AS min_position, click_count, {TS('click_time')} AS click_time,
         conversion_count, {R('total_revenue')} AS total_revenue FROM x_request_metrics""")
def _(t: Inputs) -> DataFrame:
    return fn.request_metrics(t.exposures, t.clicks, t.conversions).withColumns({
        "first_timestamp": stamp("first_timestamp"), "click_time": stamp("click_time")})


@query("fun4b_request_metrics_own_conversions", f"""
  SELECT e.request_id, e.dataset_id, e.algorithm_version, e.exposure_count, e.click_count,
         coalesce(v.n, 0) AS conversion_count, {R('coalesce(v.r, 0.0)')} AS total_revenue
  FROM x_request_metrics e
  LEFT JOIN (SELECT request_id, dataset_id, count(*) AS n, sum(revenue) AS r FROM x_conversions GROUP BY 1, 2) v
    USING (request_id, dataset_id)""")
def _(t: Inputs) -> DataFrame:
    """Conversions credited to their own request only."""
    return fn.request_metrics(t.exposures, t.clicks, t.conversions, conversions_by_request=True).select(
        "request_id", "dataset_id", "algorithm_version", "exposure_count", "click_count", "conversion_count",
        "total_revenue")


@query("fun5_metrics_by_version", f"""
  SELECT algorithm_version, exposures, clicks, conversions, {R('revenue', 2)} AS revenue,
         {R(DIV('clicks', 'exposures'))} AS ctr, {R(DIV('conversions', 'exposures'))} AS cvr
  FROM (SELECT algorithm_version, {I('sum(exposure_count)')} AS exposures, {I('sum(click_count)')} AS clicks,
               {I('sum(conversion_count)')} AS conversions, sum(total_revenue) AS revenue
        FROM x_request_metrics GROUP BY 1)""")
def _(t: Inputs) -> DataFrame:
    return fn.by_version(fn.request_metrics(t.exposures, t.clicks, t.conversions)) \
        .withColumn("revenue", F.round("revenue", 2))


@query("fun6_metrics_by_first_slot", f"""
  SELECT {I('min_position')} AS min_position, exposures, clicks, {R(DIV('clicks', 'exposures'))} AS ctr
  FROM (SELECT min_position, {I('sum(exposure_count)')} AS exposures, {I('sum(click_count)')} AS clicks
        FROM x_request_metrics GROUP BY 1)""")
def _(t: Inputs) -> DataFrame:
    return fn.by_first_slot(fn.request_metrics(t.exposures, t.clicks, t.conversions))


@query("fun7_overall_summary", f"""
  SELECT {I('sum(exposure_count)')} AS total_exposures, {I('sum(click_count)')} AS total_clicks,
         {I('sum(conversion_count)')} AS total_conversions, {R('sum(total_revenue)', 2)} AS total_revenue,
         {R(DIV('sum(click_count)', 'sum(exposure_count)'))} AS overall_ctr,
         {R(DIV('sum(conversion_count)', 'sum(exposure_count)'))} AS overall_cvr,
         (SELECT count(DISTINCT request_id) FROM x_exposures) AS unique_request_ids,
         (SELECT count(DISTINCT user_id) FROM x_exposures) AS unique_users,
         (SELECT count(DISTINCT dataset_id) FROM x_exposures) AS unique_datasets_exposed,
         (SELECT count(DISTINCT dataset_id) FROM x_clicks) AS unique_datasets_clicked
  FROM x_request_metrics""")
def _(t: Inputs) -> DataFrame:
    merged = fn.request_metrics(t.exposures, t.clicks, t.conversions)
    return fn.overall_summary(merged, t.exposures, t.clicks).withColumn("total_revenue", F.round("total_revenue", 2))


@query("fun8_proportional_version_metrics", f"""
  WITH per AS (SELECT coalesce(algorithm_version, 'unknown') AS algorithm_version, dataset_id, count(*) AS n
               FROM x_exposures GROUP BY 1, 2),
  tot AS (SELECT dataset_id, sum(n) AS t FROM per GROUP BY 1),
  s AS (SELECT min(timestamp) AS t0 FROM x_exposures),
  c AS (SELECT row_item AS dataset_id, count(*) AS n FROM x_parsed_actions, s
        WHERE row_item IS NOT NULL AND server_time >= t0 GROUP BY 1),
  v AS (SELECT dataset_id, count(*) AS n FROM x_conversions, s WHERE server_time >= t0 GROUP BY 1),
  g AS (SELECT algorithm_version, sum(per.n) AS exposures, sum(coalesce(c.n, 0) * CAST(per.n AS DOUBLE) / t) AS clicks,
               sum(coalesce(v.n, 0) * CAST(per.n AS DOUBLE) / t) AS conversions
        FROM per JOIN tot USING (dataset_id) LEFT JOIN c USING (dataset_id) LEFT JOIN v USING (dataset_id) GROUP BY 1)
  SELECT algorithm_version, {I('exposures')} AS exposures, {R('clicks')} AS clicks, {R('conversions')} AS conversions,
         {R(DIV('clicks', 'exposures'))} AS ctr, {R(DIV('conversions', 'exposures'))} AS cvr FROM g""")
def _(t: Inputs) -> DataFrame:
    return fn.proportional_version_metrics(t.exposures, at.detail_views(pe.parsed(t)), t.conversions)


def report(t: Inputs) -> DataFrame:
    views = at.detail_views(pe.parsed(t)).groupBy("dataset_id").agg(fn.rows().alias("views"))
    meta = t.raw_items.select(F.col("id").alias("dataset_id"), F.col("dataset_name").alias("title"), "price",
                              "create_company_name")
    return fn.item_report(views, pe.conversions_per_item(t), meta)


TABLES["x_report"] = f"""
  SELECT coalesce(v.dataset_id, c.dataset_id) AS dataset_id, m.dataset_name AS title, m.price, m.create_company_name,
         coalesce(v.views, 0) AS views, coalesce(c.conversions, 0) AS conversions, coalesce(c.revenue, 0.0) AS revenue,
         {DIV('coalesce(c.conversions, 0)', 'coalesce(v.views, 0)')} AS conversion_rate
  FROM (SELECT row_item AS dataset_id, count(*) AS views FROM x_parsed_actions WHERE row_item IS NOT NULL GROUP BY 1) v
  FULL JOIN x_item_conversions c USING (dataset_id)
  LEFT JOIN x_raw_items m ON m.id = coalesce(v.dataset_id, c.dataset_id)"""


@query("fun9_item_report", f"""
  SELECT dataset_id, title, {R('price')} AS price, create_company_name, views, conversions, {R('revenue')} AS revenue,
         {R('conversion_rate')} AS conversion_rate FROM x_report""")
def _(t: Inputs) -> DataFrame:
    return report(t)


@query("fun9b_item_report_totals", f"""
  SELECT count(DISTINCT dataset_id) AS total_datasets_tracked, {I('sum(views)')} AS total_views,
         {I('sum(conversions)')} AS total_conversions, {R('sum(revenue)', 4)} AS total_revenue,
         {R('avg(conversion_rate)')} AS average_conversion_rate FROM x_report""")
def _(t: Inputs) -> DataFrame:
    return fn.report_totals(report(t)).withColumn("total_revenue", F.round("total_revenue", 4))


def daily(t: Inputs) -> DataFrame:
    return fn.daily_base(t.exposures, t.clicks, t.conversions, at.detail_views(pe.parsed(t)))


_KEYS = ", ".join(fn.REPORT_KEYS)
TABLES["x_daily"] = f"""
  SELECT e.*, coalesce(c.n, 0) AS click_count, coalesce(v.n, 0) AS conversion_count,
         coalesce(v.r, 0.0) AS total_revenue, coalesce(d.n, 0) AS detail_views
  FROM (SELECT CAST(timestamp AS DATE) AS day, {_KEYS}, count(*) AS exposure_count, min(timestamp) AS first_timestamp,
               avg(score) AS avg_score, min(position) AS min_position FROM x_exposures GROUP BY ALL) e
  LEFT JOIN (SELECT CAST(server_time AS DATE) AS day, request_id, dataset_id, count(*) AS n FROM x_clicks GROUP BY ALL) c
    USING (day, request_id, dataset_id)
  LEFT JOIN (SELECT CAST(server_time AS DATE) AS day, dataset_id, count(*) AS n, sum(revenue) AS r
             FROM x_conversions GROUP BY ALL) v USING (day, dataset_id)
  LEFT JOIN (SELECT CAST(server_time AS DATE) AS day, row_item AS dataset_id, count(*) AS n FROM x_parsed_actions
             WHERE row_item IS NOT NULL GROUP BY ALL) d USING (day, dataset_id)"""


@query("fun10_daily_funnel_base", f"""
  SELECT CAST(day AS VARCHAR) AS day, {_KEYS}, exposure_count, {TS('first_timestamp')} AS first_timestamp,
         {R('avg_score')} AS avg_score, {I('min_position')} AS min_position, click_count, conversion_count,
         {R('total_revenue')} AS total_revenue, detail_views FROM x_daily""")
def _(t: Inputs) -> DataFrame:
    return daily(t).withColumns({"day": F.col("day").cast("string"), "first_timestamp": stamp("first_timestamp")})


_SUMS = f"""{I('sum(exposure_count)')} AS exposures, {I('sum(click_count)')} AS clicks,
  {I('sum(detail_views)')} AS detail_views, {I('sum(conversion_count)')} AS conversions, sum(total_revenue) AS revenue"""
_RATES = f"""exposures, clicks, detail_views, conversions, {R('revenue', 4)} AS revenue,
  {R(DIV('clicks', 'exposures'))} AS ctr, {R(DIV('detail_views', 'clicks'))} AS detail_rate,
  {R(DIV('conversions', 'exposures'))} AS cvr"""


def _split(dimensions: tuple[str, ...], keys: str = "CAST(day AS VARCHAR) AS day,") -> str:
    group = "day, " if keys else ""
    return " UNION ALL ".join(f"""
  SELECT {keys} '{d}' AS dimension, value, {_RATES}
  FROM (SELECT {group} CAST({d} AS VARCHAR) AS value, {_SUMS} FROM x_daily GROUP BY {group} {d})""" for d in dimensions)


@query("fun11_daily_breakdowns", _split(DIMENSIONS))
def _(t: Inputs) -> DataFrame:
    return fn.breakdowns(daily(t), DIMENSIONS).withColumns({
        "day": F.col("day").cast("string"), "revenue": F.round("revenue", 4)})


@query("fun12_top_items", f"""
  SELECT dataset_id, {_RATES} FROM (SELECT dataset_id, {_SUMS} FROM x_daily GROUP BY 1
  ORDER BY clicks DESC, exposures DESC, dataset_id LIMIT 10)""")
def _(t: Inputs) -> DataFrame:
    return fn.top_items(daily(t)).withColumn("revenue", F.round("revenue", 4))


@query("fun13_operations", f"""
  SELECT CAST(day AS VARCHAR) AS day, exposures, clicks, conversions, fallback_exposures,
         {R(DIV('fallback_exposures', 'exposures'))} AS fallback_ratio, {R(DIV('clicks', 'exposures'))} AS ctr
  FROM (SELECT day, {I('sum(exposure_count)')} AS exposures, {I('sum(click_count)')} AS clicks,
               {I('sum(conversion_count)')} AS conversions,
               {I('sum(CASE WHEN degrade_reason IS NOT NULL THEN exposure_count ELSE 0 END)')} AS fallback_exposures
        FROM x_daily GROUP BY 1)""")
def _(t: Inputs) -> DataFrame:
    return fn.operations(daily(t)).withColumn("day", F.col("day").cast("string"))


@query("fun13b_operation_breakdowns", _split(("variant", "experiment_variant"), "") + f""" UNION ALL
  SELECT 'degrade_reason' AS dimension, value, {_RATES}
  FROM (SELECT degrade_reason AS value, {_SUMS} FROM x_daily WHERE degrade_reason IS NOT NULL GROUP BY 1)""")
def _(t: Inputs) -> DataFrame:
    """Breakdown by degrade reason, variant and experiment variant over all days."""
    out = fn.breakdowns(daily(t), ("variant", "experiment_variant", "degrade_reason"), ())
    return out.filter("dimension <> 'degrade_reason' or value is not null").withColumn("revenue", F.round("revenue", 4))


TABLES["x_daily_summary"] = f"""
  SELECT s.*, coalesce(d.n, 0) AS total_detail_views,
         {DIV('total_clicks', 'total_exposures')} AS overall_ctr, {DIV('total_conversions', 'total_exposures')} AS overall_cvr,
         {DIV('coalesce(d.n, 0)', 'total_clicks')} AS overall_detail_rate,
         {DIV('total_conversions', 'coalesce(d.n, 0)')} AS overall_detail_to_conversion_rate
  FROM (SELECT day, {I('sum(exposure_count)')} AS total_exposures, {I('sum(click_count)')} AS total_clicks,
               {I('sum(conversion_count)')} AS total_conversions, sum(total_revenue) AS total_revenue
        FROM x_daily GROUP BY 1) s
  LEFT JOIN (SELECT CAST(server_time AS DATE) AS day, count(*) AS n FROM x_parsed_actions
             WHERE row_item IS NOT NULL GROUP BY 1) d USING (day)"""


def _delta(m: str) -> str:
    w = "OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    out = []
    for suffix, base in (("previous", f"last_value({m}) {w}"), ("average", f"avg({m}) {w}")):
        out.append(f"CASE WHEN {base} IS NOT NULL AND {base} <> 0 THEN "
                   f"{R(f'({m} - {base}) / CAST({base} AS DOUBLE)', 4)} END AS {m}_vs_{suffix}")
    return ", ".join(out)


@query("fun14_daily_deltas", "SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(_delta(m) for m in fn.DAILY_METRICS)
       + " FROM x_daily_summary")
def _(t: Inputs) -> DataFrame:
    summary = fn.daily_summary(daily(t), at.detail_views(pe.parsed(t)))
    return fn.deltas(summary).withColumn("day", F.col("day").cast("string"))


@query("fun15_trailing_series", f"""
  SELECT CAST(p.day AS VARCHAR) AS report_day, CAST(s.day AS VARCHAR) AS day, s.total_exposures, s.total_clicks,
         s.total_detail_views, s.total_conversions, {R('s.overall_ctr')} AS overall_ctr, {R('s.overall_cvr')} AS overall_cvr
  FROM x_daily_summary p JOIN x_daily_summary s ON s.day BETWEEN p.day - 7 AND p.day
  QUALIFY row_number() OVER (PARTITION BY p.day ORDER BY s.day DESC) <= 7""")
def _(t: Inputs) -> DataFrame:
    summary = fn.daily_summary(daily(t), at.detail_views(pe.parsed(t)))
    return fn.trailing_series(summary).select(
        F.col("report_day").cast("string").alias("report_day"), F.col("day").cast("string").alias("day"),
        "total_exposures", "total_clicks", "total_detail_views", "total_conversions", "overall_ctr", "overall_cvr")


@query("fun16_daily_report", f"""
  SELECT CAST(day AS VARCHAR) AS day, total_exposures, total_clicks, total_conversions, total_detail_views,
         {R('total_revenue', 2)} AS total_revenue, {R('overall_ctr')} AS overall_ctr, {R('overall_cvr')} AS overall_cvr,
         {R('overall_detail_rate')} AS overall_detail_rate,
         {R('overall_detail_to_conversion_rate')} AS overall_detail_to_conversion_rate FROM x_daily_summary""")
def _(t: Inputs) -> DataFrame:
    """Summary of every day in one pass (not one run per day)."""
    summary = fn.daily_summary(daily(t), at.detail_views(pe.parsed(t)))
    return summary.withColumns({"day": F.col("day").cast("string"), "total_revenue": F.round("total_revenue", 2)})


def all_orders(t: Inputs) -> DataFrame:
    return t.tasks.select("dataset_id", "price", "create_time").unionByName(
        t.api_orders.select(F.col("api_id").alias("dataset_id"), "price", "create_time"))


_RECON = ("1995-01-01", "2024-02-01")


@query("fun17_reconciliation", f"""
  WITH o AS (SELECT CAST(create_time AS DATE) AS day, count(item) AS n, sum(coalesce(price, 0.0)) AS r FROM x_lines GROUP BY 1),
  a AS (SELECT CAST(server_time AS DATE) AS day, count(*) AS n, count(DISTINCT idvisit) AS u FROM x_link_actions GROUP BY 1),
  v AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS t FROM x_events WHERE event_type = 'signup' GROUP BY 1),
  d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{_RECON[0]}', TIMESTAMP '{_RECON[1]}', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT CAST(day AS VARCHAR) AS day, coalesce(o.n, 0) AS business_order_count,
         {R('coalesce(o.r, 0.0)', 2)} AS business_revenue, coalesce(a.n, 0) AS matomo_exposures,
         coalesce(a.u, 0) AS matomo_unique_visits,
         CASE WHEN a.n IS NOT NULL THEN coalesce(v.t, 0) ELSE 0 END AS matomo_total_visits,
         CASE WHEN coalesce(o.n, 0) > 0 THEN {R('coalesce(a.n, 0) / CAST(o.n AS DOUBLE)', 2)} END AS exposure_to_order_ratio
  FROM d LEFT JOIN o USING (day) LEFT JOIN a USING (day) LEFT JOIN v USING (day)""")
def _(t: Inputs) -> DataFrame:
    out = fn.reconciliation(all_orders(t), t.log_link_actions, t.visits, *_RECON)
    return out.withColumn("day", F.col("day").cast("string"))


TABLES["x_samples"] = f"""
  SELECT c.request_id, c.dataset_id, c.user_id, c.event_id, c.timestamp, c.channel,
         {pe._WEIGHT} AS channel_weight, k.clicked_at, CASE WHEN k.clicked_at IS NOT NULL THEN 1 ELSE 0 END AS label,
         coalesce(c.score, 0.0) AS score, coalesce(c.position, -1) AS position,
         {', '.join(f"coalesce(c.{n}, '{d}') AS {n}" for n, d in fn.SAMPLE_DEFAULTS.items())}
  FROM (SELECT * FROM x_channelled QUALIFY row_number() OVER (PARTITION BY request_id, dataset_id
                                                             ORDER BY timestamp, event_id) = 1) c
  LEFT JOIN x_default_weights w ON c.channel = w.channel
  LEFT JOIN (SELECT request_id, dataset_id, min(server_time) AS clicked_at FROM x_clicks GROUP BY 1, 2) k
    ON k.request_id = c.request_id AND k.dataset_id = c.dataset_id"""
_SAMPLE_COLS = ", ".join(fn.SAMPLE_DEFAULTS)


def samples(t: Inputs) -> DataFrame:
    return fn.training_samples(t.exposures, t.clicks)


@query("fun18_training_samples", f"""
  SELECT request_id, dataset_id, event_id, channel, {R('channel_weight')} AS channel_weight,
         {TS('clicked_at')} AS clicked_at, CAST(label AS BIGINT) AS label, {R('score')} AS score,
         {I('position')} AS position, {_SAMPLE_COLS} FROM x_samples""")
def _(t: Inputs) -> DataFrame:
    return samples(t).select("request_id", "dataset_id", "event_id", "channel", "channel_weight",
                             stamp("clicked_at").alias("clicked_at"), "label", "score", "position",
                             *fn.SAMPLE_DEFAULTS)


TABLES["x_item_labels"] = f"""
  SELECT s.*, coalesce(v.n, 0) AS conversion_count, coalesce(v.r, 0.0) AS conversion_revenue,
         {DIV('coalesce(v.n, 0)', 'exposure_count')} AS conversion_rate
  FROM (SELECT dataset_id, max(label) AS label, {I('sum(label)')} AS click_count, count(*) AS exposure_count
        FROM x_samples GROUP BY 1) s
  LEFT JOIN (SELECT dataset_id, count(*) AS n, sum(revenue) AS r FROM x_conversions GROUP BY 1) v USING (dataset_id)"""


@query("fun19_item_labels", f"""
  SELECT dataset_id, {I('label')} AS label, click_count, exposure_count, conversion_count,
         {R('conversion_revenue')} AS conversion_revenue, {R('conversion_rate')} AS conversion_rate FROM x_item_labels""")
def _(t: Inputs) -> DataFrame:
    return fn.item_labels(samples(t), t.conversions)


TABLES["x_slot_rollup"] = """
  SELECT dataset_id, sum(exposure_count)::DOUBLE AS slot_total_exposures, sum(click_count)::DOUBLE AS slot_total_clicks,
         sum(conversion_count)::DOUBLE AS slot_total_conversions, sum(conversion_revenue) AS slot_total_revenue,
         avg(ctr) AS slot_mean_ctr, max(ctr) AS slot_max_ctr, avg(cvr) AS slot_mean_cvr,
         count(DISTINCT position)::DOUBLE AS slot_position_coverage,
         coalesce(avg(ctr) FILTER (position = 1), 0.0) AS slot_ctr_top1,
         coalesce(avg(ctr) FILTER (position <= 3), 0.0) AS slot_ctr_top3,
         coalesce(avg(cvr) FILTER (position = 1), 0.0) AS slot_cvr_top1,
         coalesce(avg(cvr) FILTER (position <= 3), 0.0) AS slot_cvr_top3
  FROM x_slot_metrics GROUP BY 1"""
SLOT_FEATURES = ("slot_total_exposures", "slot_total_clicks", "slot_total_conversions", "slot_total_revenue",
                 "slot_mean_ctr", "slot_max_ctr", "slot_mean_cvr", "slot_position_coverage", "slot_ctr_top1",
                 "slot_ctr_top3", "slot_cvr_top1", "slot_cvr_top3")


@query("fun20_slot_rollup",
       f"SELECT dataset_id, {', '.join(f'{R(c)} AS {c}' for c in SLOT_FEATURES)} FROM x_slot_rollup")
def _(t: Inputs) -> DataFrame:
    return fn.slot_rollup(first_events(t)["recommend_slot_metrics"])


@query("fun21_fallback_share", f"""
  SELECT endpoint, exposures, fallback_exposures, {R(DIV('fallback_exposures', 'exposures'))} AS fallback_ratio
  FROM (SELECT coalesce(endpoint, 'unknown') AS endpoint, count(*) AS exposures,
               count(*) FILTER (degrade_reason IS NOT NULL) AS fallback_exposures FROM x_exposures GROUP BY 1)""")
def _(t: Inputs) -> DataFrame:
    return fn.fallback_share(t.exposures)
