"""Writers: raw loads, upserts, marks, views, key-value exports and event logs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wayfunnel.operators.relational import outer_union, pick, top_per_group
from wayfunnel.sinks.log import CommitLog

BUCKETS = 64  # of a keyed table, fixed by its first load


def append_load(df: DataFrame, path: str, load_time: str) -> None:
    """Append one load as its own ``load_time=`` partition."""
    df.withColumn("load_time", F.lit(load_time)).write.mode("append").partitionBy("load_time").parquet(path)


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str = "load_seq",
             tie: Sequence[str] = ()) -> DataFrame:
    """Union of both with the newest row per key (largest load number, then the tie columns)."""
    return pick(existing.unionByName(new, allowMissingColumns=True), keys,
                [F.desc_nulls_last(sequence), *[F.desc_nulls_last(c) for c in tie]])


def _stored(spark: SparkSession, manifest: Mapping[str, str], buckets: Sequence[str] | None = None) -> DataFrame | None:
    places = [manifest[b] for b in sorted(manifest) if buckets is None or b in buckets]
    return spark.read.option("mergeSchema", True).parquet(*places) if places else None


def current_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a keyed table, or none before its first load."""
    _, entry = CommitLog(spark, f"{path}/_log").newest()
    return _stored(spark, entry["files"]) if entry else None


def upsert(new: DataFrame, path: str, keys: Sequence[str], sequence: str = "load_seq", tie: Sequence[str] = (),
           buckets: int = BUCKETS, observed: Observation | None = None, metrics: Sequence[Column] = ()) -> int:
    """Merge rows into a keyed table; returns the number of the version.

    Keys are dealt out to a fixed number of buckets, and only those that the load touches are written anew. A version is a
    log entry that names the files of each bucket. It is created only if no other writer has taken its number; otherwise
    the load is merged again where that writer touched the same buckets, so neither loses rows. A failed job leaves the
    last version in place, and a repeated load (same ``sequence``) changes nothing. Of new rows with one key the first by
    ``sequence``, then ``tie`` counts; ``tie`` columns aren't stored. ``metrics`` are observed while the load is staged.
    """
    spark, log = new.sparkSession, CommitLog(new.sparkSession, f"{path}/_log")
    number, entry = log.newest()
    buckets = entry["buckets"] if entry else buckets
    counted = new.observe(observed, *metrics) if observed is not None else new
    single = pick(counted, keys, [F.desc_nulls_last(c) for c in (sequence, *tie)]).drop(*tie)
    staged = f"{path}/staged-{uuid.uuid4().hex}"
    single.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).write.parquet(staged)
    load = spark.read.parquet(staged)
    touched = [str(r["_bucket"]) for r in load.select("_bucket").distinct().collect()]  # at most ``buckets`` rows
    merged_from: dict[str, str] | None = None
    location = ""
    while True:
        files = entry["files"] if entry else {}
        before = {b: files[b] for b in touched if b in files}
        if before != merged_from:
            existing = _stored(spark, before)
            merged = load.drop("_bucket") if existing is None else existing.unionByName(load.drop("_bucket"), allowMissingColumns=True)
            merged = pick(merged, keys, [F.desc_nulls_last(sequence)])
            location, merged_from = f"{path}/data-{uuid.uuid4().hex}", before
            merged.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")) \
                .repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(location)
        after = {**files, **{b: f"{location}/_bucket={b}" for b in touched}}
        if log.commit(number + 1, {"buckets": buckets, "files": after, "touched": sorted(touched)}):
            log.delete(staged)
            return number + 1
        number, entry = log.newest()


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the last ``keep`` versions and delete the buckets that only older ones name; returns how many."""
    log = CommitLog(spark, f"{path}/_log")
    numbers = log.numbers()
    entries = {n: log.read(n) for n in numbers}
    needed = {place for n in numbers[-keep:] for place in entries[n]["files"].values()}
    gone = {place for n in numbers[:-keep] for place in entries[n]["files"].values()} - needed
    for n in numbers[:-keep]:
        log.forget(n)
    for place in gone:
        log.delete(place)
    return len(gone)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the stored schema in its order; what does not fit becomes null."""
    present = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schema.fields])


def append_conformed(df: DataFrame, path: str) -> None:
    try:
        schema = df.sparkSession.read.parquet(path).schema
    except AnalysisException:
        schema = df.schema
    conform(df, schema).write.mode("append").parquet(path)


def high_water_mark(df: DataFrame, source: str, table: str, column: str) -> DataFrame:
    """Largest value of the incremental column over the whole load."""
    value = F.date_format(F.max(F.col(column).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return df.agg(value.alias("mark")).select(F.lit(source).alias("source"), F.lit(table).alias("table_name"),
                                              F.lit(column).alias("column"), "mark")


def write_observed(df: DataFrame, path: str, table: str, mode: str, column: str | None = None) -> DataFrame:
    """Append a load and return its metrics row; rows and the mark are counted while they are written."""
    seen = Observation(f"load-{uuid.uuid4().hex}")
    newest = F.max(F.col(column).cast("timestamp_ntz")) if column else F.lit(None).cast("timestamp_ntz")
    df.observe(seen, F.count(F.lit(1)).alias("row_count"), F.max(newest).alias("mark") if not column else newest.alias("mark")) \
        .write.mode("append").parquet(path)
    found = seen.get
    mark = found["mark"].strftime("%Y-%m-%dT%H:%M:%S") if found["mark"] else None
    return df.sparkSession.createDataFrame([(table, mode, found["row_count"], mark)], "table_name string, mode string, row_count long, mark string")


def save_views(views: Mapping[str, tuple[DataFrame, Sequence[str]]], folder: str) -> None:
    """Write each table once and register it under its name and its older names."""
    for name, (df, aliases) in views.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        stored = df.sparkSession.read.parquet(f"{folder}/{name}")
        for alias in (name, *aliases):
            stored.createOrReplaceTempView(alias)


def view_metadata(views: Mapping[str, DataFrame], refreshed_at: str) -> DataFrame:
    """Row counts of the non-empty views: (view_name, refreshed_at, row_count)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(n).alias("view_name"), F.lit(refreshed_at).alias("refreshed_at"), "row_count") for n, df in views.items()]
    return outer_union(parts).filter("row_count > 0")


def snapshot_id(metadata: DataFrame) -> DataFrame:
    """sha1 over the sorted `view:refreshed_at` pairs joined by a pipe (one row per view)."""
    pair = F.concat_ws(":", "view_name", "refreshed_at")
    return metadata.agg(F.sha1(F.array_join(F.sort_array(F.collect_list(pair)), "|")).alias("snapshot_id"))


def key_values(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, fields): every value as text, null as "0", keyed ``prefix:{id}``."""
    names = [c for c in df.columns if c != key]
    values = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in names])
    return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("key"),
                     F.map_from_arrays(F.array(*[F.lit(c) for c in names]), values).alias("fields"))


def history_lists(interactions: DataFrame, limit: int = 50) -> DataFrame:
    """Newest items per user as one list; the cut comes before the list is built."""
    cut = top_per_group(interactions, ["user_id"], [F.desc("last_event_time"), F.asc("dataset_id")], limit, "_r")
    return cut.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("_r", "dataset_id"))).alias("c")) \
        .select("user_id", F.transform("c", lambda x: x["dataset_id"]).alias("items"))


def exposure_events(ranked: DataFrame, context: DataFrame, context_columns: Sequence[str], stamped: Column) -> DataFrame:
    """Nested exposure events, one per request; ``ranked`` holds at most a response list per request."""
    cell = F.struct("rank", F.col("item").alias("dataset_id"), "score", "reason")
    lists = ranked.groupBy("request_id").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    items = F.transform("c", lambda x: F.struct(x["dataset_id"].alias("dataset_id"), x["score"].alias("score"),
                                                x["reason"].alias("reason")))
    joined = lists.join(context, "request_id", "left")
    return joined.select(F.concat(F.lit("req_"), F.col("request_id").cast("string")).alias("request_id"), "user_id",
                         stamped.alias("timestamp"), items.alias("items"), F.struct(*context_columns).alias("context"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
