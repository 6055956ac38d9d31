"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "wayfunnel", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators rely on.

    On a cluster leave ``master`` unset; AQE then sizes the reduce side, splits
    skewed join partitions and picks broadcast joins from measured sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-wayfunnel-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def written(df: DataFrame, label: str, *layout: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder (by the columns ``layout``, if any) and read it back.

    The files survive lost executors, and the scan has sizes and column pruning that a
    checkpointed RDD would not offer the optimiser.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wayfunnel/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(layout) or None)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that a later one has replaced; nothing may read it any more."""
    spark = df.sparkSession
    mark = f"/wayfunnel/{spark.sparkContext.applicationId}/"
    for folder in {f.split(mark)[0] + mark + f.split(mark)[1].split("/")[0] for f in df.inputFiles() if mark in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
