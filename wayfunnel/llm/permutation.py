"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order and posted in the
inverted files of the first few. A query visits the files of its own nearest pivots, ranks what is posted there by the
footrule distance of the two orders, and scores the better part by the inner product. Vectors are first lifted to one
norm (a further coordinate fills each up to the largest), where the largest inner product is the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.llm._tables import Scratch
from wayfunnel.llm._text import lean

PIVOTS = 2048  # the most; 8 times the root of the number of vectors, if that is less
POSTED = 8  # files that list a vector
ORDERED = 16  # pivots in a vector's representation
VISITED = 10  # a query visits one file in so many
RERANKED = 0.8  # share of a file, the best by footrule, that is scored
FILES = 16  # inverted files in one task's group
BLOCK = 4096  # the most postings or visits of a pivot in one group


class Pivots:
    """Unit vectors in the lifted space with their ids; bounded, sent to every task."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: float):
        self.norm, self.ids, self.originals = norm, ids, vectors
        self.lifted = self.lift(vectors)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm ** 2 - (vectors ** 2).sum(axis=1)))
        return np.column_stack([vectors, rest])

    def order(self, vectors: np.ndarray, count: int, *, query: bool = False) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        lifted = np.column_stack([vectors, np.zeros(len(vectors))]) if query else self.lift(vectors)
        near = lifted @ self.lifted.T
        count = min(count, near.shape[1])
        some = np.argpartition(-near, count - 1, axis=1)[:, :count]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``v`` (doubles): finite, not zero, of the most frequent length; of rows with one id the least vector."""
    v = F.col(vector_column).cast("array<double>")
    good = table.select(F.col(id_column).alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return good.join(F.broadcast(length), F.size("v") == F.col("n")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def _posted(classes: DataFrame, pivots: Pivots, visits: int, query: bool, width: str) -> DataFrame:
    """A row for each vector and file: the file, the vector's id, its order of pivots and its components (``width``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                vectors = _matrix(part.column(1))
                order = pivots.order(vectors, visits if query else ORDERED, query=query)
                files = order[:, :visits]
                own = np.repeat(np.arange(len(vectors)), files.shape[1])
                packed = pa.array([x.tobytes() for x in order.astype(np.int16)], pa.binary())
                vectors = pa.array([x.tobytes() for x in vectors.astype(width)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(files.ravel().astype(np.int32)), part.column(0).take(pa.array(own)),
                                                  packed.take(pa.array(own)), vectors.take(pa.array(own))], names=["file", "id", "pivots", "v"])

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "v").mapInArrow(lean(run), f"file int, id {kind}, pivots binary, v binary")


def _in_blocks(posted: DataFrame, blocks: DataFrame, own: str, other: str) -> DataFrame:
    """Deal a file's rows out to blocks by a hash, a copy for each block of the other side."""
    return (posted.join(F.broadcast(blocks), "file")
            .withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
            .select((F.col("file") / FILES).cast("int").alias("g"), "x", "q", "file", "id", "pivots", "v"))


def neighbours(table: DataFrame, queries: DataFrame, k: int = 20, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``table`` with the largest inner products for each row of ``queries``, the row itself left out.

    Returns ``query_id``, ``rank`` (from 1), the id column and ``score``; ties go to the smaller id. Null, zero and
    non-finite vectors and those of another length take no part; of rows with one id the least vector counts. Equal
    vectors are one class in the index, so however many copies a vector has, its files don't grow. Fewer rows than
    ``k`` come only where fewer candidates exist or the visited files hold fewer.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "permutation")
    points = scratch.table(usable(table, id_column, vector_column))
    # a class's smallest k + 1 ids are enough for any answer
    classes = scratch.table(points.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    total, norm = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    kind = table.schema[id_column].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_column} {kind}, score double")
    count = max(1, min(PIVOTS, int(8 * total ** 0.5)))
    share = min(1.0, 1.2 * (count + 50) / total)
    rows = (classes.select("id", "v", F.xxhash64(F.lit(11), "id").alias("h")).filter(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
            .orderBy("h").limit(count).collect())
    pivots = Pivots(np.array([r.v for r in rows]), np.array([r.id for r in rows]), norm)
    visits = max(min(count, 24), -(-count // VISITED))
    asked = usable(queries, id_column, vector_column)

    single = all(t.schema[vector_column].dataType == T.ArrayType(T.FloatType()) for t in (table, queries))
    width = "<f4" if single else "<f8"  # what holds the components without loss
    files = _posted(classes, pivots, min(POSTED, count), False, width)
    visiting = _posted(asked, pivots, visits, True, width)
    files, visiting = scratch.table(files), scratch.table(visiting)
    sizes = [side.groupBy("file").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n_{name}")) for side, name in ((files, "x"), (visiting, "q"))]
    blocks = scratch.table(sizes[0].join(sizes[1], "file"))  # at most a row for each pivot

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Visits and postings of a group of files: the best k + 1 classes of each query."""
        out: dict = {}
        for file, visits_here in left.groupby("file"):
            posted = right[right.file == file]
            if not len(posted):
                continue
            ids = posted.id.to_numpy()
            orders = np.stack([np.frombuffer(x, np.int16) for x in posted.pivots]).astype(np.int64)
            vectors = np.stack([np.frombuffer(x, width) for x in posted.v]).astype(np.float64)
            for lo in range(0, len(visits_here), 128):
                part = visits_here.iloc[lo:lo + 128]
                own = np.stack([np.frombuffer(x, np.int16) for x in part.pivots]).astype(np.int64)
                place = np.full((len(part), count), own.shape[1], np.int32)
                np.put_along_axis(place, own, np.arange(own.shape[1], dtype=np.int32)[None, :], 1)
                footrule = np.zeros((len(part), len(posted)), np.int32)
                for j in range(orders.shape[1]):
                    footrule += np.abs(place[:, orders[:, j]] - j)
                asking = np.stack([np.frombuffer(x, width) for x in part.v]).astype(np.float64)
                scores = asking @ vectors.T
                kept = max(min(len(posted), 2 * k), int(len(posted) * RERANKED))
                if kept < len(posted):
                    scores[footrule > np.partition(footrule, kept - 1, axis=1)[:, kept - 1:kept]] = -np.inf
                best = min(k + 1, len(posted))
                top = np.argpartition(-scores, best - 1, axis=1)[:, :best]
                for query, asks, at, row in zip(part.id.to_numpy(), asking, top, scores, strict=True):
                    # a tie at the cut must not lose the smaller id
                    at = np.flatnonzero(row >= row[at].min() - 1e-12) if np.isfinite(row[at].min()) else at[np.isfinite(row[at])]
                    exact = (vectors[at] * asks).sum(axis=1)  # a product's last bits depend on the block's shape
                    out.setdefault(query, {}).update(zip(ids[at].tolist(), exact.tolist(), strict=True))
        rows = [(query, i, s) for query, found in out.items() for i, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k + 1]]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"])

    found = (_in_blocks(visiting, blocks, "q", "x").groupBy("g", "x", "q")
             .cogroup(_in_blocks(files, blocks, "x", "q").groupBy("g", "x", "q"))
             .applyInPandas(search, f"query_id {kind}, id {kind}, score double"))
    best = (found.groupBy("query_id").agg(F.collect_set(F.struct((-F.col("score")).alias("s"), "id")).alias("all"))
            .select("query_id", F.explode(F.slice(F.array_sort("all"), 1, k + 1)).alias("c"))
            .select("query_id", F.col("c.id").alias("class"), F.negative("c.s").alias("score")))
    members = _smallest(points.join(classes.filter("n > 1").select("v", F.col("id").alias("class")), "v"), k + 1)
    answer = (best.join(members, "class", "left")
              .select("query_id", "score", F.explode(F.coalesce("ids", F.array("class"))).alias("id")).filter("query_id <> id"))
    return (answer.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")).alias("all"))
            .select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("p", "c"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("c.id").alias(id_column), F.negative("c.s").alias("score")))


def _smallest(members: DataFrame, count: int) -> DataFrame:
    """The ``count`` smallest ids of each class, first by salted shares of a class, then over these."""
    first = F.slice(F.array_sort(F.collect_list("id")), 1, count)
    salted = (members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256))).groupBy("class", "salt").agg(first.alias("ids")))
    return (salted.select("class", F.explode("ids").alias("id")).groupBy("class").agg(first.alias("ids")))
