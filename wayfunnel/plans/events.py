"""Queries for log parsing and event attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import Inputs, stored
from wayfunnel.functions import events as ev
from wayfunnel.functions.text import stamp
from wayfunnel.operators import attribution as at
from wayfunnel.operators.funnel import rows
from wayfunnel.plans.oracle import ITEM, I, R, TABLES, TS
from wayfunnel.plans.registry import query

KNOWN = ("behavior", "content", "vector", "popular", "tag", "category", "price", "usercf", "image")


@stored
def parsed(t: Inputs) -> DataFrame:
    return at.parsed_actions(t.log_link_actions, at.action_dictionary(t.log_actions))


TABLES["x_asof"] = """
  SELECT c.buster, max_by(struct_pack(r := a.dim_request, p := a.slot, i := coalesce(a.meta_item, a.row_item)),
                          struct_pack(t := a.server_time, i := a.idlink_va)) AS s
  FROM x_log_conversions c
  JOIN x_parsed_actions a ON a.idvisit = c.idvisit AND a.server_time <= c.server_time AND a.dim_request IS NOT NULL
  WHERE c.d4 IS NULL OR NOT starts_with(c.d4, 'req_')
  GROUP BY c.buster"""

TABLES["x_attributed"] = f"""
  SELECT c.buster, c.server_time, coalesce(c.revenue, 0.0) AS revenue,
         coalesce(d.item, {ITEM('c.url')}, s.i) AS dataset_id,
         CASE WHEN starts_with(c.d4, 'req_') THEN c.d4 ELSE s.r END AS request_id,
         coalesce(CASE WHEN regexp_full_match(c.d4, '\\d+') THEN CAST(c.d4 AS BIGINT) END, s.p) AS position
  FROM x_log_conversions c LEFT JOIN x_dictionary d ON c.idaction_url = d.idaction
  LEFT JOIN x_asof USING (buster)
  WHERE coalesce(d.item, {ITEM('c.url')}, s.i) IS NOT NULL"""


@query("src8_action_dictionary", f"SELECT idaction, item FROM x_dictionary")
def _(t: Inputs) -> DataFrame:
    return at.action_dictionary(t.log_actions)


@query("evt1_item_from_text", f"SELECT idaction, {ITEM('name')} AS item FROM x_log_actions")
def _(t: Inputs) -> DataFrame:
    return t.log_actions.select("idaction", ev.item_from_text("name").alias("item"))


@query("evt2_item_of_action", "SELECT idlink_va, row_item FROM x_parsed_actions")
def _(t: Inputs) -> DataFrame:
    return at.with_item(t.log_link_actions, at.action_dictionary(t.log_actions), "idlink_va", ev.ACTION_ID_COLUMNS,
                        ev.ACTION_TEXT_COLUMNS, "row_item").select("idlink_va", "row_item")


@query("evt3_click_metadata", r"""
  SELECT idlink_va, TRY_CAST(nullif(regexp_extract(trim(d5), '^click_(\d+)_([0-9]+)', 1), '') AS BIGINT) AS slot,
         TRY_CAST(nullif(regexp_extract(trim(d5), '^click_(\d+)_([0-9]+)', 2), '') AS BIGINT) AS item
  FROM x_link_actions""")
def _(t: Inputs) -> DataFrame:
    return t.log_link_actions.select("idlink_va", ev.click_slot().alias("slot"), ev.click_item().alias("item"))


@query("evt4_slot_of_action", "SELECT idlink_va, slot FROM x_parsed_actions")
def _(t: Inputs) -> DataFrame:
    return t.log_link_actions.select("idlink_va", ev.slot_of(ev.slot_columns()).alias("slot"))


@query("evt5_request_of_action",
       "SELECT idlink_va, coalesce(dim_request, url_request) AS request_id FROM x_parsed_actions")
def _(t: Inputs) -> DataFrame:
    return t.log_link_actions.select("idlink_va", ev.request_of(ev.request_columns()).alias("request_id"))


@query("evt6_configured_dimensions", """
  SELECT idlink_va, coalesce(CASE WHEN starts_with(d2, 'req_') THEN d2 END,
                             CASE WHEN starts_with(d4, 'req_') THEN d4 END) AS request_id FROM x_link_actions""")
def _(t: Inputs) -> DataFrame:
    """Dimension 2 configured first, the always-read ones after it."""
    return t.log_link_actions.select(
        "idlink_va", ev.request_from_columns(ev.request_columns("2, x")).alias("request_id"))


@query("evt7_recommend_click_test",
       "SELECT idlink_va, (from_recommend OR dim_request IS NOT NULL) AS is_recommend FROM x_parsed_actions")
def _(t: Inputs) -> DataFrame:
    return t.log_link_actions.select("idlink_va", ev.is_recommend_click(ev.request_columns()).alias("is_recommend"))


@query("evt8_recommend_clicks", f"""
  SELECT idlink_va, dataset_id, request_id, {TS('server_time')} AS server_time, position FROM x_log_clicks""")
def _(t: Inputs) -> DataFrame:
    return at.recommend_clicks(parsed(t)).withColumn("server_time", stamp("server_time"))


@query("evt9_recommend_conversions", f"""
  SELECT buster, dataset_id, request_id, {TS('server_time')} AS server_time, {R('revenue')} AS revenue, position
  FROM x_attributed""")
def _(t: Inputs) -> DataFrame:
    """Own request id, else as-of within the visit."""
    return at.recommend_conversions(t.log_conversions, parsed(t), at.action_dictionary(t.log_actions)) \
        .withColumn("server_time", stamp("server_time"))


@query("evt10_detail_views", f"""
  SELECT row_item AS dataset_id, {TS('server_time')} AS server_time, count(*) AS views
  FROM x_parsed_actions WHERE row_item IS NOT NULL GROUP BY 1, 2""")
def _(t: Inputs) -> DataFrame:
    return at.detail_views(parsed(t)).groupBy("dataset_id", stamp("server_time").alias("server_time")) \
        .agg(rows().alias("views"))


@query("evt11_views_per_item",
       "SELECT row_item AS dataset_id, count(*) AS views FROM x_parsed_actions WHERE row_item IS NOT NULL GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    return at.detail_views(parsed(t)).groupBy("dataset_id").agg(rows().alias("views"))


def conversions_per_item(t: Inputs) -> DataFrame:
    found = at.with_item(t.log_conversions, at.action_dictionary(t.log_actions), "buster", ("idaction_url",), ("url",))
    return found.filter("item is not null").groupBy(F.col("item").alias("dataset_id")).agg(
        rows().alias("conversions"), F.sum(F.coalesce("revenue", F.lit(0.0))).alias("revenue"))


TABLES["x_item_conversions"] = f"""
  SELECT coalesce(d.item, {ITEM('c.url')}) AS dataset_id, count(*) AS conversions,
         sum(coalesce(c.revenue, 0.0)) AS revenue
  FROM x_log_conversions c LEFT JOIN x_dictionary d ON c.idaction_url = d.idaction
  WHERE coalesce(d.item, {ITEM('c.url')}) IS NOT NULL GROUP BY 1"""


@query("evt12_conversions_per_item",
       f"SELECT dataset_id, conversions, {R('revenue')} AS revenue FROM x_item_conversions")
def _(t: Inputs) -> DataFrame:
    return conversions_per_item(t)


TABLES["x_first_exposures"] = """
  SELECT * FROM x_exposures
  QUALIFY row_number() OVER (PARTITION BY request_id, dataset_id ORDER BY timestamp, event_id) = 1"""
TABLES["x_first_clicks"] = """
  SELECT * FROM x_clicks
  QUALIFY row_number() OVER (PARTITION BY request_id, dataset_id ORDER BY server_time, event_id) = 1"""
TABLES["x_first_conversions"] = """
  SELECT * FROM x_conversions
  QUALIFY row_number() OVER (PARTITION BY request_id, dataset_id ORDER BY server_time, event_id) = 1"""
for _kind in ("clicks", "conversions"):
    TABLES[f"x_slotted_{_kind}"] = f"""
  SELECT c.* REPLACE (coalesce(c.position, e.position, -1) AS position)
  FROM x_first_{_kind} c LEFT JOIN x_first_exposures e
    ON c.request_id IS NOT DISTINCT FROM e.request_id AND c.dataset_id = e.dataset_id"""


@query("evt13_first_event_per_pair", f"""
  SELECT request_id, dataset_id, event_id, {TS('server_time')} AS server_time FROM x_first_conversions""")
def _(t: Inputs) -> DataFrame:
    return at.first_per_request_item(t.conversions, "server_time", "event_id").select(
        "request_id", "dataset_id", "event_id", stamp("server_time").alias("server_time"))


@query("evt14_filled_slots", f"SELECT event_id, request_id, dataset_id, {I('position')} AS position FROM x_slotted_clicks")
def _(t: Inputs) -> DataFrame:
    shown = at.first_per_request_item(t.exposures, "timestamp", "event_id")
    clicks = at.first_per_request_item(t.clicks, "server_time", "event_id")
    return at.fill_slots(clicks, shown).select("event_id", "request_id", "dataset_id", "position")


@query("evt15_attached_context", """
  WITH ctx AS (SELECT DISTINCT request_id, dataset_id, variant, endpoint, page_id, algorithm_version FROM x_exposures)
  SELECT c.event_id, c.request_id, c.dataset_id, variant, endpoint, page_id, algorithm_version
  FROM x_clicks c LEFT JOIN ctx USING (request_id, dataset_id)""")
def _(t: Inputs) -> DataFrame:
    return at.attach_context(t.clicks.select("event_id", "request_id", "dataset_id"), t.exposures)


_TOKENS = "list_filter(string_split(lower(trim(coalesce(reason, ''))), '+'), lambda x: x <> '')"


@query("evt16_channel_first_token", f"""
  SELECT event_id, CASE WHEN len({_TOKENS}) = 0 THEN 'unknown' WHEN starts_with({_TOKENS}[1], 'fallback') THEN 'fallback'
                        ELSE {_TOKENS}[1] END AS channel FROM x_exposures""")
def _(t: Inputs) -> DataFrame:
    return t.exposures.select("event_id", ev.channel_first("reason").alias("channel"))


@query("evt17_channel_first_known_token", f"""
  WITH k AS (SELECT event_id, {_TOKENS} AS tokens FROM x_exposures),
  h AS (SELECT event_id, tokens, list_filter(tokens, lambda x: x IN {KNOWN} OR starts_with(x, 'fallback'))[1] AS hit FROM k)
  SELECT event_id, CASE WHEN len(tokens) = 0 THEN 'unknown'
                        WHEN hit IS NULL THEN tokens[1]
                        WHEN hit IN {KNOWN} THEN hit ELSE 'fallback' END AS channel FROM h""")
def _(t: Inputs) -> DataFrame:
    return t.exposures.select("event_id", ev.channel_first_known("reason", KNOWN).alias("channel"))


TABLES["x_default_weights"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {v}::DOUBLE)" for k, v in ev.LABEL_CHANNEL_WEIGHTS.items()) + ") AS w(channel, weight)"
TABLES["x_channelled"] = f"""
  SELECT *, CASE WHEN len({_TOKENS}) = 0 THEN 'unknown' WHEN starts_with({_TOKENS}[1], 'fallback') THEN 'fallback'
            ELSE {_TOKENS}[1] END AS channel FROM x_exposures"""
_WEIGHT = """coalesce(CASE WHEN c.channel_weights LIKE '{%' THEN
    TRY_CAST(nullif(regexp_extract(c.channel_weights, '"' || c.channel || '":\\s*([0-9.]+)', 1), '') AS DOUBLE) END,
    w.weight, 0.1)"""


@query("evt18_channel_weight", f"""
  SELECT event_id, c.channel, {R(_WEIGHT)} AS weight
  FROM x_channelled c LEFT JOIN x_default_weights w ON c.channel = w.channel""")
def _(t: Inputs) -> DataFrame:
    return t.exposures.withColumn("channel", ev.channel_first("reason")).select(
        "event_id", "channel", ev.channel_weight("channel_weights", "channel").alias("weight"))


@query("jn6_asof_within_visit", f"""
  SELECT c.buster, s.r AS request_id, CAST(s.p AS BIGINT) AS position
  FROM x_log_conversions c LEFT JOIN x_asof USING (buster) WHERE c.d4 IS NULL OR NOT starts_with(c.d4, 'req_')""")
def _(t: Inputs) -> DataFrame:
    states = parsed(t).filter("dimension_request is not null")
    own = ev.request_from_columns(ev.request_columns())
    open_rows = t.log_conversions.filter(own.isNull()).select("buster", "idvisit", "server_time")
    return at.as_of_last(open_rows, states, "idvisit", "server_time", "idlink_va", ("dimension_request", "position")) \
        .select("buster", F.col("state_dimension_request").alias("request_id"),
                F.col("state_position").alias("position"))
