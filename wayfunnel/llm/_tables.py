"""Intermediate tables in the shared folder, and membership filters of a fixed size."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfunnel.session import shared_folder

BITS = 1 << 24


class Scratch:
    """Tables of one job below ``spark.checkpoint.dir``; superseded ones can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/wayfunnel/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
        path, self.count = f"{self.path}/{self.count}", self.count + 1
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, *partition_by: str) -> DataFrame:
        return self.write(df, *partition_by)[0]

    def drop(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Bits:
    """A filter of ``bits`` bits over 64-bit codes: false for most codes outside, true for every code within.

    Its size doesn't grow with the data (2 MB), so it may be broadcast; a fuller filter lets more codes through,
    and an exact join always follows.
    """

    def __init__(self, codes: DataFrame, bits: int = BITS):
        self.bits = bits
        at = F.pmod(F.col(codes.columns[0]), F.lit(bits)) + 1
        rows = (codes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect())
        whole = np.zeros(bits // 8, np.uint8)
        for row in rows:  # at most bits / 32768 rows
            whole[(row.bucket - 1) * 4096:row.bucket * 4096] = np.frombuffer(row.bitmap, np.uint8)
        self.empty = not rows
        self._whole = codes.sparkSession.sparkContext.broadcast(whole)

    def __getstate__(self) -> tuple:
        return self.bits, self.empty, self._whole

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.empty, self._whole = state

    def has(self, codes: np.ndarray) -> np.ndarray:
        """``codes``: unsigned or signed 64-bit values; the number of bits is a power of two."""
        at = codes.astype(np.uint64, copy=False) & np.uint64(self.bits - 1)
        return (self._whole.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))
