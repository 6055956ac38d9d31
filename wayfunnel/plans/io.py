"""Queries for sources, sinks and streams, fed from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.adapters import Inputs, every
from wayfunnel.functions.text import stamp
from wayfunnel.plans import features as pf
from wayfunnel.plans import funnel as pfun
from wayfunnel.plans import ranking as prk
from wayfunnel.plans import recall as pr
from wayfunnel.plans.oracle import R, TABLES, TS
from wayfunnel.plans.registry import query
from wayfunnel.schemas import INTERACTIONS
from wayfunnel.session import shared_folder, written
from wayfunnel.sinks import ingest
from wayfunnel.sinks import writers as wr
from wayfunnel.sources import readers as rd
from wayfunnel.streaming import jobs


def folder(t: Inputs, label: str) -> str:
    return f"{shared_folder(t.spark)}/wayfunnel/{label}-{uuid.uuid4().hex}"


# -- sources ----------------------------------------------------------------------

EXPORTS = ("task.json", "task_20240101_000000.json", "task_20240201_000000.json")


def json_export(t: Inputs, path: str, parts: Sequence[int] = (0, 1, 2)) -> str:
    """Orders as JSON exports: a full file and two increments (folders of part files per name)."""
    rows = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("create_user"),
                                    F.col("o_totalprice").cast("string").alias("price"),
                                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    for part in parts:
        rows.filter(every("id", 3, part)).write.json(f"{path}/{EXPORTS[part]}")
    return path


EXPORT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("create_user", T.LongType()),
                              T.StructField("price", T.StringType()), T.StructField("create_time", T.StringType())])


@query("src1_json_bootstrap", f"""
  SELECT o_orderkey AS id, o_custkey AS create_user, {R('o_totalprice')} AS price, {TS('o_orderdate')} AS create_time,
         CASE o_orderkey % 3 WHEN 1 THEN '2024-01-01 00:00:00' WHEN 2 THEN '2024-02-01 00:00:00' END AS file_time FROM orders""")
def _(t: Inputs) -> DataFrame:
    full = rd.json_table(t.spark, json_export(t, folder(t, "json")), "task", EXPORT_SCHEMA, multi_line=False)
    return full.withColumns({"create_time": stamp("create_time"), "file_time": stamp("file_time")})


@query("src2_later_increments", f"""
  SELECT o_orderkey AS id, o_custkey AS create_user, {R('o_totalprice')} AS price, {TS('o_orderdate')} AS create_time,
         '2024-02-01 00:00:00' AS file_time FROM orders WHERE o_orderkey % 3 = 2""")
def _(t: Inputs) -> DataFrame:
    """Increments named later than the mark: the last of the two."""
    later = rd.json_table(t.spark, json_export(t, folder(t, "json")), "task", EXPORT_SCHEMA, "2024-01-01T00:00:00", multi_line=False)
    return later.withColumns({"create_time": stamp("create_time"), "file_time": stamp("file_time")})


def marked_loads(t: Inputs) -> tuple[str, str]:
    """A bootstrap load, and a load of what came later."""
    path = folder(t, "marked")
    for parts in ((0, 1), (2,)):
        json_export(t, f"{path}/in", parts)
        ingest.load_json(t.spark, f"{path}/in", "task", EXPORT_SCHEMA, f"{path}/table", f"{path}/state", ["id"], multi_line=False)
    return f"{path}/table", f"{path}/state"


@query("src2b_marked_loads", f"""
  SELECT o_orderkey AS id, {R('o_totalprice')} AS price, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS load_seq FROM orders""")
def _(t: Inputs) -> DataFrame:
    """The table after two loads; the second takes every increment named later than the saved mark, which is a time in the data."""
    return wr.current_version(t.spark, marked_loads(t)[0]).select("id", "price", "load_seq")


@query("snk4b_saved_marks", """
  SELECT 1 AS load, 'business' AS source, 'task' AS table_name, 'create_time' AS "column", 'full' AS mode,
         strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS mark, count(*) AS row_count FROM orders WHERE o_orderkey % 3 < 2
  UNION ALL SELECT 2, 'business', 'task', 'create_time', 'incremental',
         strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S'), count(*) FROM orders WHERE o_orderkey % 3 > 0""")
def _(t: Inputs) -> DataFrame:
    return ingest.saved_marks(t.spark, marked_loads(t)[1], "task")


@query("src4_incremental_columns", """
  SELECT 'orders' AS table_name, 'o_orderdate' AS "column", strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS newest FROM orders
  UNION ALL SELECT 'events', 'ts', strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events
  UNION ALL SELECT 'lineitem', 'l_shipdate', strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem
  UNION ALL SELECT 'part', NULL, NULL""")
def _(t: Inputs) -> DataFrame:
    """Chosen incremental column per table of the given data."""
    picked = [(n, rd.incremental_column(n, t.table(n).schema)) for n in ("orders", "events", "lineitem", "part")]
    newest = {n: t.table(n).agg(rd.newest(c).alias("m")) for n, c in picked if c}
    out = None
    for name, column in picked:
        row = (newest[name] if column else t.table(name).agg(F.max(F.lit(None).cast("string")).alias("m"))) \
            .select(F.lit(name).alias("table_name"), F.lit(column).cast("string").alias("column"), F.col("m").alias("newest"))
        out = row if out is None else out.unionByName(row)
    return out


def exposure_lines(t: Inputs) -> DataFrame:
    """Log lines of two items per view event, with broken lines, ids and prefixes among them."""
    e = t.events.filter(F.col("event_type") == "view")
    item = F.concat(F.lit('{"dataset_id": '), F.when(every("event_id", 5), F.lit('"x"')).otherwise(F.col("k").cast("string")),
                    F.lit(', "score": '), F.when(every("event_id", 3), F.lit('"bad"')).otherwise(F.lit("1.5")),
                    F.lit(', "reason": "content"}'))
    second = F.concat(F.lit('{"dataset_id": "'), F.col("k") + 1, F.lit('", "reason": "tag"}'))
    line = F.concat(F.lit('{"request_id": "'), F.when(every("event_id", 7), "mock_").otherwise("req_"), F.col("event_id"),
                    F.lit('", "user_id": '), F.col("user_id"), F.lit(', "timestamp": "'),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('", "items": ['), item, F.lit(", "), second,
                    F.lit('], "context": {"endpoint": "recommend_detail", "channel_weights": {"tag": 0.5}}}'))
    return e.select(F.when(every("event_id", 11), "{broken").otherwise(line).alias("value"))


_LINE_SQL = """
  WITH e AS (SELECT * FROM x_events WHERE event_type = 'view' AND event_id % 11 <> 0 {0})
  SELECT 'req' AS p, event_id, user_id, ts, k AS dataset_id, 0 AS position, event_id % 5 <> 0 AS ok, CASE WHEN event_id % 3 <> 0 THEN 1.5::DOUBLE END AS score FROM e
  UNION ALL SELECT 'req', event_id, user_id, ts, k + 1, 1, true, 0.0::DOUBLE FROM e"""


def _lines_sql(prefix_filter: str) -> str:
    return f"""WITH l AS ({_LINE_SQL.format(prefix_filter)})
  SELECT CASE WHEN event_id % 7 = 0 THEN 'mock_' ELSE 'req_' END || event_id AS request_id, user_id, dataset_id, {R('score')} AS score, position,
         'recommend_detail' AS endpoint, '{{"tag":0.5}}' AS channel_weights, {TS('ts')} AS timestamp FROM l WHERE ok"""


def _parsed(t: Inputs, prefix: bool) -> DataFrame:
    return rd.parse_exposures(exposure_lines(t), require_prefix=prefix).select(
        "request_id", "user_id", "dataset_id", "score", "position", "endpoint", "channel_weights", stamp("timestamp").alias("timestamp"))


@query("src5_exposure_log", _lines_sql("AND event_id % 7 <> 0"))
def _(t: Inputs) -> DataFrame:
    return _parsed(t, True)


@query("src6_exposure_log_any_request", _lines_sql(""))
def _(t: Inputs) -> DataFrame:
    return _parsed(t, False)


@query("src7_optional_table", "SELECT event_id, user_id, CAST(NULL AS DOUBLE) AS weight FROM events")
def _(t: Inputs) -> DataFrame:
    expected = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("weight", T.DoubleType())])
    there = rd.optional_parquet(t.spark, f"{t.root}/events.parquet", expected)
    absent = rd.optional_parquet(t.spark, f"{t.root}/no_such_table.parquet", INTERACTIONS)
    return there.select("event_id", "user_id", "weight").join(absent.select("user_id"), "user_id", "left_anti")


@query("src9_optional_side_inputs", """
  SELECT m.dataset_id, e.label FROM x_items m LEFT JOIN embeddings e ON e.vec_id = m.dataset_id""")
def _(t: Inputs) -> DataFrame:
    base = rd.optional_side(pf.items(t).select("dataset_id"), None, ["dataset_id"])
    return rd.optional_side(base, t.vectors.select("dataset_id", "label"), ["dataset_id"])


@query("src10_stored_neighbours", f"""
  SELECT src, dst, {R('score')} AS score FROM x_vector_sim""")
def _(t: Inputs) -> DataFrame:
    """Neighbour lists written as JSON objects and pairs, read back as a long table."""
    pairs = pr.vector_table(t)
    entry = F.when(every("src", 2), F.to_json(F.struct(F.col("dst").alias("dataset_id"), "score"))) \
        .otherwise(F.concat(F.lit("["), F.col("dst"), F.lit(", "), F.col("score"), F.lit("]")))
    lists = pairs.withColumn("e", entry).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "e"))).alias("c"))
    text = F.concat(F.lit('{"'), F.col("src"), F.lit('": ['), F.array_join(F.transform("c", lambda x: x["e"]), ","), F.lit("]}"))
    from wayfunnel.operators.recall import stored_neighbours
    return stored_neighbours(lists.select(text.alias("line")), "line").select("src", "dst", "score")


# -- sinks ------------------------------------------------------------------------

def two_loads(t: Inputs) -> tuple[DataFrame, DataFrame]:
    base = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    first = base.withColumn("load_seq", F.lit(1))
    second = base.filter(every("id", 3)).withColumn("status", F.lit("X")).unionByName(
        base.filter(every("id", 5)).select((F.col("id") + 10_000_000).alias("id"), "status")).withColumn("load_seq", F.lit(2))
    return first, second


@query("snk1_partitioned_loads", """
  SELECT 'a' AS load_time, count(*) AS n FROM orders UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderkey % 3 = 0""")
def _(t: Inputs) -> DataFrame:
    path = folder(t, "loads")
    wr.append_load(t.table("orders"), path, "a")
    wr.append_load(t.table("orders").filter(every("o_orderkey", 3)), path, "b")
    return t.spark.read.parquet(path).groupBy("load_time").agg(F.count(F.lit(1)).alias("n"))


@query("snk2_upserted", """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders
  UNION ALL SELECT o_orderkey + 10000000, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0""")
def _(t: Inputs) -> DataFrame:
    path = folder(t, "upsert")
    for load in two_loads(t):
        wr.upsert(load, path, ["id"])
    return wr.current_version(t.spark, path).select("id", "status")


@query("snk3_conformed_append", """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders""")
def _(t: Inputs) -> DataFrame:
    path = folder(t, "append")
    base = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    base.filter(~every("id", 2)).write.parquet(path)
    wr.append_conformed(base.filter(every("id", 2)).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("extra")), path)
    return t.spark.read.parquet(path).select("id", "status")


@query("snk4_high_water_mark", """
  SELECT 'business' AS source, 'orders' AS table_name, 'o_orderdate' AS "column", strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS mark FROM orders""")
def _(t: Inputs) -> DataFrame:
    return wr.high_water_mark(t.table("orders"), "business", "orders", "o_orderdate")


@query("snk5_load_metrics", """
  SELECT 'orders' AS table_name, 'full' AS mode, count(*) AS row_count, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS mark FROM orders""")
def _(t: Inputs) -> DataFrame:
    """Counted in the pass that writes."""
    return wr.write_observed(t.table("orders"), folder(t, "metrics"), "orders", "full", "o_orderdate")


@query("snk6_saved_views", """
  SELECT 'user_features' AS view_name, count(*) AS n FROM x_users UNION ALL SELECT 'dataset_stats', count(*) FROM x_stats""")
def _(t: Inputs) -> DataFrame:
    wr.save_views({"user_features_v2": (pf.user_features(t), ["user_features"]),
                   "dataset_stats_v2": (pf.item_stats(t), ["dataset_stats"])}, folder(t, "views"))
    parts = [t.spark.table(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("view_name"), "n")
             for n in ("user_features", "dataset_stats")]
    return parts[0].union(parts[1])


TABLES["x_view_meta"] = """
  SELECT 'interactions' AS view_name, '2024-01-01T00:00:00' AS refreshed_at, count(*) AS row_count FROM x_inter
  UNION ALL SELECT 'user_profile', '2024-01-01T00:00:00', count(*) FROM x_users"""


def view_meta(t: Inputs) -> DataFrame:
    return wr.view_metadata({"interactions": pf.interactions(t), "user_profile": pf.users(t)}, "2024-01-01T00:00:00")


@query("snk7_view_metadata", "SELECT * FROM x_view_meta")
def _(t: Inputs) -> DataFrame:
    return view_meta(t)


@query("snk8_snapshot_id", "SELECT sha1(string_agg(view_name || ':' || refreshed_at, '|' ORDER BY view_name || ':' || refreshed_at)) AS snapshot_id FROM x_view_meta")
def _(t: Inputs) -> DataFrame:
    return wr.snapshot_id(view_meta(t))


@query("snk9_user_key_values", """
  SELECT 'user:' || user_id AS key, province, CAST(is_consumption AS VARCHAR) AS is_consumption FROM x_users""")
def _(t: Inputs) -> DataFrame:
    kv = wr.key_values(pf.users(t), "user_id", "user")
    return kv.select("key", F.col("fields")["province"].alias("province"), F.col("fields")["is_consumption"].alias("is_consumption"))


@query("snk10_item_key_values", """
  SELECT 'dataset_stats:' || dataset_id AS key, CAST(interaction_count AS VARCHAR) AS interaction_count FROM x_stats""")
def _(t: Inputs) -> DataFrame:
    kv = wr.key_values(pf.item_stats(t), "dataset_id", "dataset_stats")
    return kv.select("key", F.col("fields")["interaction_count"].alias("interaction_count"))


@query("snk11_user_history", """
  SELECT user_id, string_agg(CAST(dataset_id AS VARCHAR), ',' ORDER BY recency_rank) AS items FROM x_history WHERE recency_rank <= 20 GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    lists = wr.history_lists(pf.interactions(t), 20)
    return lists.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("snk12_report_files", """
  SELECT count(*) AS n, CAST(sum(views) AS BIGINT) AS views FROM x_report""")
def _(t: Inputs) -> DataFrame:
    path = folder(t, "report")
    wr.write_report(pfun.report(t), path)
    back = t.spark.read.option("header", True).csv(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("views").cast("long")).alias("views"))


@query("snk13_exposure_events")
def _(t: Inputs) -> DataFrame:
    """Ranked lists written as nested log lines and parsed back."""
    path = folder(t, "events")
    ranked = prk.diversified(t)
    context = prk.requests(t).select("request_id", "user_id", "endpoint", "source", "device_type")
    wr.write_json_lines(wr.exposure_events(ranked, context, ["endpoint", "source", "device_type"],
                                           F.lit("2024-01-01T00:00:00")), path)
    return rd.exposure_log(t.spark, path).select("request_id", "dataset_id", "position", "endpoint", "reason")


# -- streams ----------------------------------------------------------------------

def stream_of(t: Inputs, build: Callable[[Inputs], DataFrame], label: str) -> DataFrame:
    """A file stream over a batch table written once to the shared folder."""
    table = written(build(t), label)
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    return t.spark.readStream.schema(table.schema).parquet(path)


def drained(t: Inputs, out: DataFrame, label: str) -> DataFrame:
    """Run the stream over what is there into files and read them."""
    path = folder(t, label)
    q = out.writeStream.format("parquet").outputMode("append").option("path", path) \
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(path)


def web_events(t: Inputs) -> DataFrame:
    return t.events.select("event_id", "ts", "event_type", F.col("k").alias("dataset_id"), "value",
                           F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("kind"))


@query("str1_ingest_with_upsert", """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS load_seq FROM orders""")
def _(t: Inputs) -> DataFrame:
    """Two runs of the stream; the second one's rows replace those of the first."""
    source, target = folder(t, "stream-in"), folder(t, "stream-table")
    rows = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
    for part in (rows, rows.filter(every("id", 3)).withColumn("status", F.lit("X"))):
        part.write.mode("append").json(source)
        jobs.ingest_with_upsert(t.spark, source, schema, target, ["id"], f"{target}-checkpoint", multi_line=False).awaitTermination()
    return wr.current_version(t.spark, target).select("id", "status", "load_seq")


@query("str2_trending_windows", """
  WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events WHERE event_type IN ('view', 'click'))
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, k AS dataset_id,
         CAST(sum(CASE event_type WHEN 'view' THEN 1 ELSE 3 END) AS BIGINT) AS score
  FROM x_events, m WHERE event_type IN ('view', 'click') AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2""")
def _(t: Inputs) -> DataFrame:
    """Closed one-hour windows."""
    out = jobs.trending(stream_of(t, web_events, "web-events"), "1 hour")
    return drained(t, out, "trending").select(stamp("start").alias("start"), "dataset_id", "score")


@query("str3_exposure_stream", """
  SELECT count(*) AS n, count(DISTINCT request_id) AS requests FROM (SELECT DISTINCT 'req_' || event_id AS request_id, dataset_id FROM (
    SELECT event_id, k AS dataset_id FROM x_events WHERE event_type = 'view' AND event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0
    UNION ALL SELECT event_id, k + 1 FROM x_events WHERE event_type = 'view' AND event_id % 11 <> 0 AND event_id % 7 <> 0))""")
def _(t: Inputs) -> DataFrame:
    out = jobs.exposures(stream_of(t, exposure_lines, "exposure-lines"))
    return drained(t, out.drop("at"), "exposure-stream").agg(F.count(F.lit(1)).alias("n"),
                                                            F.count_distinct("request_id").alias("requests"))


@query("str4_attributed_stream")
def _(t: Inputs) -> DataFrame:
    """Exposures joined with clicks of the next hour."""
    shown = stream_of(t, lambda x: x.exposures.select("request_id", "dataset_id", "position", "timestamp"), "shown")
    clicks = stream_of(t, lambda x: x.clicks.select("request_id", "dataset_id", "server_time"), "clicked")
    return drained(t, jobs.attributed(shown, clicks), "attributed")


@query("str5_running_ctr")
def _(t: Inputs) -> DataFrame:
    return drained(t, jobs.running_ctr(stream_of(t, web_events, "web-events"), ["dataset_id"]), "ctr")


@query("str6_fallback_alerts")
def _(t: Inputs) -> DataFrame:
    shown = stream_of(t, lambda x: x.exposures.select("endpoint", "degrade_reason", "timestamp"), "fallback-in")
    return drained(t, jobs.fallback_alert(shown, "1 hour"), "fallback")


@query("str7_service_alerts")
def _(t: Inputs) -> DataFrame:
    asks = stream_of(t, lambda x: x.events.select("ts", (F.col("event_type") == "error").alias("is_error"),
                                                  F.col("value").alias("latency_ms")), "requests-in")
    return drained(t, jobs.service_alert(asks), "service")


@query("str8_silence_alerts")
def _(t: Inputs) -> DataFrame:
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, store)
    try:
        shown = stream_of(t, lambda x: x.exposures.select("endpoint", "timestamp"), "silence-in")
        return drained(t, jobs.silence_alert(shown), "silence")
    finally:
        t.spark.conf.set(key, before)
