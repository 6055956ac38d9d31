"""Readers of business exports, logs and stored tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wayfunnel.operators.projections import coerce
from wayfunnel.schemas import EXPOSURE_LINE, GENERIC_INCREMENTAL, INCREMENTAL_PREFERENCE

# Conversions applied to text columns of the JSON exports.
JSON_CONVERSIONS: dict[str, dict[str, str]] = {
    "user": {"create_time": "datetime", "last_login_time": "datetime"},
    "dataset": {"price": "float", "create_time": "datetime", "update_time": "datetime"},
    "task": {"price": "float", "create_time": "datetime", "update_time": "datetime"},
    "api_order": {"price": "float", "api_price": "float", "create_time": "datetime", "update_time": "datetime",
                  "pay_time": "datetime"},
    "dataset_image": {"create_time": "datetime", "update_time": "datetime"},
}
CONTEXT_FIELDS = ("endpoint", "variant", "experiment_variant", "degrade_reason", "model_run_id", "feature_snapshot_id",
                  "source", "device_type", "locale", "client_app", "channel_weights")


def incremental_column(table: str, schema: T.StructType) -> str | None:
    """Preferred column of the table, else a generic name, else the first date or time column."""
    names = set(schema.names)
    for name in (*INCREMENTAL_PREFERENCE.get(table, ()), *GENERIC_INCREMENTAL):
        if name in names:
            return name
    for field in schema.fields:
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return field.name
    return None


def newest(column: str) -> Column:
    """The largest time as text, with all six digits of the fraction if any row has one: text leaves out their last zeros."""
    time = F.col(column).cast("timestamp_ntz")
    text = F.max(time).cast("string")
    whole = F.rpad(F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
    return F.when(F.max(F.contains(time.cast("string"), F.lit("."))), whole).otherwise(text)


def _stamp_of_file() -> Column:
    """Time in the name of the increment: a file, or a folder of part files."""
    found = F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{8}_\d{6})\.json(?:/[^/]*)?$", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def json_increments(spark: SparkSession, folder: str, table: str, schema: T.StructType, mark: str | None, multi_line: bool = True) -> DataFrame:
    """Increments `table_YYYYMMDD_HHMMSS.json` named later than the mark, with their file time."""
    pattern = f"{folder}/{table}_[0-9]*.json"
    try:
        raw = spark.read.schema(schema).option("multiLine", multi_line).json(pattern)
    except AnalysisException:
        return spark.createDataFrame([], schema).withColumn("file_time", F.lit(None).cast("timestamp_ntz"))
    out = raw.withColumn("file_time", _stamp_of_file()).filter("file_time is not null")
    return out.filter(F.col("file_time") > F.lit(mark).cast("timestamp_ntz")) if mark else out


def json_table(spark: SparkSession, folder: str, table: str, schema: T.StructType, mark: str | None = None, multi_line: bool = True) -> DataFrame:
    """Bootstrap without a mark: the full file and all increments. With a mark: later increments only."""
    out = json_increments(spark, folder, table, schema, mark, multi_line)
    if mark is None:
        try:
            full = spark.read.schema(schema).option("multiLine", multi_line).json(f"{folder}/{table}.json")
            out = full.withColumn("file_time", F.lit(None).cast("timestamp_ntz")).unionByName(out)
        except AnalysisException:
            pass
    return coerce(out, JSON_CONVERSIONS.get(table, {}))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, mark: str | None = None,
               partition: tuple[str, int, int, int] | None = None, fetch_size: int = 50_000, **options: str) -> DataFrame:
    """Full or incremental extract; the mark becomes a filter that the source evaluates.

    ``partition`` = (numeric column, lower, upper, number of parallel readers).
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options)
    if partition:
        name, low, high, n = partition
        reader = reader.options(partitionColumn=name, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    df = reader.load()
    return df.filter(F.col(column) > F.lit(mark).cast(df.schema[column].dataType)) if column and mark else df


def parse_exposures(lines: DataFrame, column: str = "value", require_prefix: bool = True) -> DataFrame:
    """Exposure log lines (one JSON request per line) to one row per shown item.

    Broken lines, requests without id (or without the ``req_`` prefix) and items whose id is
    not an integer are dropped; a score that is not a number becomes null.
    """
    parsed = lines.select(F.from_json(F.trim(F.col(column)), EXPOSURE_LINE).alias("r")).select("r.*")
    keep = F.col("request_id").isNotNull() & (F.col("request_id") != "")
    if require_prefix:
        keep = keep & F.col("request_id").startswith("req_")
    # whole numbers only, as in an integer conversion of the id
    ident = F.when(F.col("item.dataset_id").rlike(r"^\s*-?\d+\s*$"), F.trim("item.dataset_id").try_cast("long"))
    shown = parsed.filter(keep).select("*", F.posexplode("items").alias("position", "item"))
    score = F.col("item.score").try_cast("double")
    return shown.select(
        "request_id", "algorithm_version", "user_id", "page_id",
        *[F.col(f"context.{c}").alias(c) for c in CONTEXT_FIELDS],
        ident.alias("dataset_id"),
        F.when(F.col("item.score").isNull(), 0.0).otherwise(F.when(F.isnan(score), None).otherwise(score)).alias("score"),
        F.col("item.reason").alias("reason"),
        F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"), "position") \
        .filter("dataset_id is not null")


def exposure_log(spark: SparkSession, path: str, require_prefix: bool = True) -> DataFrame:
    return parse_exposures(spark.read.text(path), require_prefix=require_prefix)


def optional_parquet(spark: SparkSession, path: str, expected: T.StructType, strict: bool = False) -> DataFrame:
    """A missing table is an empty typed one; absent expected columns are null (or an error)."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], expected)
    absent = [f.name for f in expected.fields if f.name not in df.columns]
    if absent and strict:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in expected.fields if f.name in absent}) if absent else df


def optional_side(base: DataFrame, side: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Left join of a side table when there is one."""
    return base if side is None else base.join(side, list(keys), "left")


def table_name_of(path: str) -> str:
    return re.sub(r"(_\d{8}_\d{6})?\.json$", "", path.rsplit("/", 1)[-1])
