"""Turning raw web logs into exposures, clicks and conversions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions import events as ev
from wayfunnel.functions.common import col, with_defaults
from wayfunnel.operators.relational import fits_broadcast, pick
from wayfunnel.session import written

PIECE_ROWS = 1_000_000  # of a timeline, sorted in one task

# Defaults for the grouping context of exposures.
CONTEXT_DEFAULTS = {"variant": "default", "endpoint": "unknown", "page_id": "", "algorithm_version": "unknown"}
CONTEXT = tuple(CONTEXT_DEFAULTS)


def action_dictionary(actions: DataFrame) -> DataFrame:
    """idaction -> item, for the actions whose name is an item url."""
    return actions.select(F.col("idaction").cast("long"), ev.item_from_text("name").alias("item")) \
        .filter(F.col("item").isNotNull())


def with_item(rows: DataFrame, dictionary: DataFrame, key: str, id_columns: Sequence[str],
              text_columns: Sequence[str], out: str = "item") -> DataFrame:
    """Item of each row: first hit of the id columns in the dictionary, else of the text columns.

    A dictionary of checked size is joined on the map side, once per id column
    over one shared broadcast. Beyond that size the non-null ids are unpivoted to
    (row key, priority, id), joined once, and the best hit comes back by row key.
    """
    ids = [c for c in id_columns if c in rows.columns]
    texts = [ev.item_from_text(c) for c in text_columns if c in rows.columns]
    if fits_broadcast(dictionary):
        small = F.broadcast(dictionary)
        joined, hits = rows, []
        for i, c in enumerate(ids):
            side = small.select(F.col("idaction").alias(f"_id{i}"), F.col("item").alias(f"_hit{i}"))
            joined = joined.join(side, F.col(c).cast("long") == F.col(f"_id{i}"), "left").drop(f"_id{i}")
            hits.append(f"_hit{i}")
        return joined.withColumn(out, F.coalesce(*[F.col(h) for h in hits], *texts)).drop(*hits)
    slots = F.array(*[F.struct(F.lit(i).alias("p"), F.col(c).cast("long").alias("id")) for i, c in enumerate(ids)])
    narrow = rows.select(key, F.explode(F.filter(slots, lambda s: s["id"].isNotNull())).alias("s"))
    found = narrow.join(dictionary, F.col("s.id") == F.col("idaction")).groupBy(key).agg(
        F.min_by("item", "s.p").alias("_hit"))
    return rows.join(found, key, "left").withColumn(out, F.coalesce("_hit", *texts)).drop("_hit")


def parsed_actions(link_actions: DataFrame, dictionary: DataFrame, request_dims: str | None = None,
                   slot_dims: str | None = None) -> DataFrame:
    """Link actions with item, slot and request id read out of them."""
    requests, slots = ev.request_columns(request_dims), ev.slot_columns(slot_dims)
    rows = with_item(link_actions, dictionary, "idlink_va", ev.ACTION_ID_COLUMNS, ev.ACTION_TEXT_COLUMNS, "row_item")
    return rows.select(
        "idlink_va", "idvisit", "server_time", "row_item",
        ev.click_item().alias("meta_item"),
        ev.slot_of(slots).alias("position"),
        ev.request_from_columns(requests).alias("dimension_request"),
        ev.request_of(requests).alias("request_id"),
        ev.is_recommend_click(requests).alias("is_recommend"))


def recommend_clicks(parsed: DataFrame) -> DataFrame:
    item = F.coalesce("row_item", "meta_item")
    return parsed.filter(F.col("is_recommend") & item.isNotNull() & F.col("request_id").isNotNull()
                         & F.col("server_time").isNotNull()) \
        .select(item.alias("dataset_id"), "request_id", "server_time", "position", "idlink_va")


def detail_views(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("row_item").isNotNull() & F.col("server_time").isNotNull()) \
        .select(F.col("row_item").alias("dataset_id"), "server_time")


def timeline_pieces(events: DataFrame, states: DataFrame, key: str, time: str, state_id: str, columns: Sequence[str],
                    piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Events (``_kind`` 1) and states (0) in order of key and time, cut into numbered pieces of about ``piece_rows`` rows.

    The order has no ties between different rows, so one key at one instant can lie in any number of pieces.
    """
    payload = F.struct(F.col(time).alias("_at"), F.col(state_id).alias("_sid"), *[F.col(c) for c in columns])
    left = events.withColumns({"_kind": F.lit(1), "_tie": F.xxhash64(*events.columns)})
    right = states.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(time), F.lit(0).alias("_kind"), payload.alias("_state"))
    timeline = left.unionByName(right, allowMissingColumns=True)
    pieces = max(1, -(-timeline.count() // piece_rows))
    ranged = timeline.repartitionByRange(pieces, key, time, "_kind", "_state._sid", "_tie")
    return written(ranged.withColumn("_piece", F.spark_partition_id()), "timeline")


def as_of_last(events: DataFrame, states: DataFrame, key: str, time: str, state_id: str,
               columns: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Attach to each event the latest state of the same key at or before its time.

    A scan in two passes over ordered pieces of bounded size: the first finds the state that each
    piece leaves behind for its last key, and a table with one row per piece carries these on to the
    pieces in which that key continues; the second looks for the latest state inside the piece and
    takes the carried one where there is none.
    """
    pieces = timeline_pieces(events, states, key, time, state_id, columns, piece_rows)
    ends = pieces.groupBy("_piece").agg(
        F.min(key).alias("_open"), F.max(key).alias("_close"),
        F.max(F.when(F.col("_kind") == 0, F.struct(F.col(key).alias("k"), F.col("_state").alias("s")))).alias("_last"))
    left_behind = ends.select("_piece", F.col("_close").alias("_k"), F.when(F.col("_last.k") == F.col("_close"), F.col("_last.s")).alias("_s"),
                              F.lit(False).alias("_asks"))
    asked = ends.select("_piece", F.col("_open").alias("_k"), F.lit(None).cast(left_behind.schema["_s"].dataType).alias("_s"), F.lit(True).alias("_asks"))
    earlier = Window.partitionBy("_k").orderBy("_piece").rangeBetween(Window.unboundedPreceding, -1)  # a row for each piece
    carried = left_behind.unionByName(asked).withColumn("_carry", F.last("_s", ignorenulls=True).over(earlier)) \
        .filter("_asks and _carry is not null").select("_piece", F.col("_k").alias("_carried_key"), "_carry")

    upto = Window.partitionBy("_piece", key).orderBy(F.col(time), "_kind", F.col("_state._sid")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    seen = pieces.withColumn("_seen", F.last("_state", ignorenulls=True).over(upto)).filter("_kind = 1")
    joined = seen.join(carried, "_piece", "left")
    state = F.coalesce("_seen", F.when(F.col(key) == F.col("_carried_key"), F.col("_carry")))
    return joined.select(*events.columns, *[state[c].alias(f"state_{c}") for c in columns])


def recommend_conversions(conversions: DataFrame, parsed: DataFrame, dictionary: DataFrame,
                          request_dims: str | None = None, slot_dims: str | None = None) -> DataFrame:
    """Conversions with a request id: their own dimension, else the latest action of the
    visit that carried one; item and slot fall back to that action too."""
    requests, slots = ev.request_columns(request_dims), ev.slot_columns(slot_dims)
    rows = with_item(conversions, dictionary, "buster", ("idaction_url",), ("url",), "own_item") \
        .filter(F.col("server_time").isNotNull()) \
        .select("buster", "idvisit", "server_time", "own_item",
                F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"),
                ev.slot_of(slots, click=None).alias("own_slot"),
                ev.request_from_columns(requests).alias("own_request"))
    direct = rows.filter("own_request is not null or idvisit is null").select(
        F.col("own_item").alias("dataset_id"), F.col("own_request").alias("request_id"), "server_time", "revenue",
        F.col("own_slot").alias("position"), "buster")
    states = parsed.filter("dimension_request is not null").select(
        "idvisit", "server_time", "idlink_va", "dimension_request", "position",
        F.coalesce("meta_item", "row_item").alias("action_item"))
    matched = as_of_last(rows.filter("own_request is null and idvisit is not null"), states, "idvisit",
                         "server_time", "idlink_va", ("dimension_request", "position", "action_item"))
    derived = matched.select(
        F.coalesce("own_item", "state_action_item").alias("dataset_id"),
        F.col("state_dimension_request").alias("request_id"), "server_time", "revenue",
        F.coalesce("own_slot", "state_position").alias("position"), "buster")
    return direct.unionByName(derived).filter("dataset_id is not null")


def first_per_request_item(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Earliest event per (request, item); rows without a request count as one request per item."""
    return pick(df, ["request_id", "dataset_id"], [F.col(time).asc_nulls_last(), F.col(tie).asc()])


def fill_slots(df: DataFrame, exposures: DataFrame) -> DataFrame:
    """Missing slot taken from the exposure of the same (request, item), else -1.

    Null request ids match each other, as they are one request per item here.
    """
    slots = exposures.select(F.col("request_id").alias("_r"), F.col("dataset_id").alias("_d"),
                             F.col("position").alias("_p"))
    joined = df.join(slots, df["request_id"].eqNullSafe(F.col("_r")) & (df["dataset_id"] == F.col("_d")), "left")
    return joined.withColumn("position", F.coalesce("position", "_p", F.lit(-1)).cast("int")).drop("_r", "_d", "_p")


def standard_context(df: DataFrame) -> DataFrame:
    return with_defaults(df, CONTEXT_DEFAULTS)


def attach_context(df: DataFrame, exposures: DataFrame) -> DataFrame:
    """Exposure context of each click or conversion (one row per distinct context)."""
    lookup = exposures.select("request_id", "dataset_id", *CONTEXT).distinct()
    return df.join(lookup, ["request_id", "dataset_id"], "left")


def coalesce_columns(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), [col(n) for n in names])
