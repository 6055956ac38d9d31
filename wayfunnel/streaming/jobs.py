"""Structured Streaming jobs over the same column expressions as the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wayfunnel.functions.common import ratio
from wayfunnel.operators.recall import CLICK_WEIGHT, VIEW_WEIGHT
from wayfunnel.sinks.writers import upsert
from wayfunnel.sources.readers import parse_exposures

# Alert limits.
FALLBACK_LIMIT, ERROR_LIMIT, LATENCY_LIMIT_MS = 0.2, 0.05, 200.0


def _zoned(c: str) -> Column:
    return F.col(c).cast("timestamp")


def ingest_with_upsert(spark: SparkSession, folder: str, schema: T.StructType, target: str, keys: Sequence[str],
                       checkpoint: str, multi_line: bool = True) -> StreamingQuery:
    """New JSON files are merged into a keyed table; the checkpoint replaces a saved mark.

    Of rows with one key in a batch the one of the latest file counts, and in a file the last one.
    """
    stream = spark.readStream.schema(schema).option("multiLine", multi_line).json(folder) \
        .withColumns({"_file_time": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_path"),
                      "_block": F.col("_metadata.file_block_start")})

    def merge(batch: DataFrame, number: int) -> None:
        placed = batch.withColumns({"load_seq": F.lit(number), "_row": F.monotonically_increasing_id()})
        upsert(placed, target, keys, tie=("_file_time", "_file", "_block", "_row"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trending(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Weighted views and clicks per item and event-time window."""
    value = F.when(F.col("event_type") == "view", VIEW_WEIGHT).when(F.col("event_type") == "click", CLICK_WEIGHT)
    timed = events.filter(F.col("event_type").isin("view", "click")).withColumn("at", _zoned("ts")).withWatermark("at", late)
    span = F.window("at", window, slide) if slide else F.window("at", window)
    return timed.groupBy(span.alias("w"), "dataset_id").agg(F.sum(value).alias("score")) \
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "dataset_id", "score")


def exposures(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Exposure log lines to one first row per (request, item)."""
    shown = parse_exposures(lines).withColumn("at", _zoned("timestamp"))
    return shown.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id", "dataset_id"])


def attributed(shown: DataFrame, clicks: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Exposures left joined with later clicks of the same (request, item)."""
    e = shown.withColumn("shown_at", _zoned("timestamp")).withWatermark("shown_at", late) \
        .select("request_id", "dataset_id", "position", "shown_at")
    c = clicks.withColumn("clicked_at", _zoned("server_time")).withWatermark("clicked_at", late) \
        .select(F.col("request_id").alias("c_request"), F.col("dataset_id").alias("c_item"), "clicked_at")
    on = (F.col("request_id") == F.col("c_request")) & (F.col("dataset_id") == F.col("c_item")) \
        & (F.col("clicked_at") >= F.col("shown_at")) & (F.col("clicked_at") <= F.col("shown_at") + F.expr(f"INTERVAL {within}"))
    return e.join(c, on, "leftOuter").select("request_id", "dataset_id", "position", "shown_at", "clicked_at")


def running_ctr(events: DataFrame, keys: Sequence[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed exposures, clicks and CTR; ``events`` has ``kind`` = view | click."""
    timed = events.withColumn("at", _zoned("ts")).withWatermark("at", late)
    per = timed.groupBy(F.window("at", window).alias("w"), *keys).agg(
        F.count_if(F.col("kind") == "view").alias("exposures"), F.count_if(F.col("kind") == "click").alias("clicks"))
    return per.select(F.col("w.start").alias("start"), *keys, "exposures", "clicks", ratio("clicks", "exposures").alias("ctr"))


def fallback_alert(shown: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    timed = shown.withColumn("at", _zoned("timestamp")).withWatermark("at", late)
    per = timed.groupBy(F.window("at", window).alias("w"), F.coalesce("endpoint", F.lit("unknown")).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("exposures"), F.count_if(F.col("degrade_reason").isNotNull()).alias("fallbacks"))
    share = ratio("fallbacks", "exposures")
    return per.select(F.col("w.start").alias("start"), "endpoint", "exposures", share.alias("fallback_ratio"),
                      (share > FALLBACK_LIMIT).alias("alert"))


def service_alert(requests: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Error rate and 95th percentile latency over sliding windows."""
    timed = requests.withColumn("at", _zoned("ts")).withWatermark("at", late)
    per = timed.groupBy(F.window("at", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"),
        F.percentile_approx("latency_ms", 0.95).alias("p95"))
    rate = ratio("errors", "requests")
    return per.select(F.col("w.start").alias("start"), "requests", rate.alias("error_rate"), "p95",
                      ((rate > ERROR_LIMIT) | (F.col("p95") > LATENCY_LIMIT_MS)).alias("alert"))


class SilenceWatch(StatefulProcessor):
    """Emits one row per endpoint when no exposure arrived for five event-time minutes."""

    QUIET_MS = 5 * 60 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max((int(pdf["at"].max().timestamp() * 1000) for pdf in rows if len(pdf)), default=0)
        known = self.last.get()[0] if self.last.exists() else 0
        if newest > known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.QUIET_MS)
        yield pd.DataFrame({"endpoint": pd.Series(dtype="str"), "silent_since_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"endpoint": [key[0]], "silent_since_ms": [self.last.get()[0]]})

    def close(self) -> None:
        pass


def silence_alert(shown: DataFrame, late: str = "1 minute") -> DataFrame:
    """Needs the RocksDB state store provider."""
    timed = shown.select(F.coalesce("endpoint", F.lit("unknown")).alias("endpoint"), _zoned("timestamp").alias("at")) \
        .withWatermark("at", late)
    return timed.groupBy("endpoint").transformWithStateInPandas(
        statefulProcessor=SilenceWatch(), outputStructType="endpoint string, silent_since_ms long", outputMode="Append",
        timeMode="EventTime")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available into an in-memory table (for tests and small reports)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
