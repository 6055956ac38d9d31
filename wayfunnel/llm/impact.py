"""Exact top-k by inner product from an impact-ordered index, read score at a time.

Components become integers, floor(64 * x). A block of vectors has one posting list for each dimension, ordered by the
magnitude of the component; postings of one magnitude are a segment, and a query's component times that magnitude is the
segment's impact. A query reads segments of all dimensions by falling impact, one level of impacts after the other, and
adds what they bring to its accumulators. What a vector can still gain or lose is bounded by the largest unread impact of
as many dimensions as it hasn't been seen in. Reading ends once that bound proves that only few vectors can reach the
score to beat; exactly these are scored from their components, so every answer is exact.

The score to beat comes from the block's own best at first. One block is searched before the others, and its k-th scores
are what the other blocks have to reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.llm._tables import Scratch
from wayfunnel.operators.relational import pick, top_per_group

QUANTA = 64
MOST = 1 << 25  # magnitudes from here on would take sums out of 64 bits
BLOCK, QUERIES = 16384, 1024  # vectors and queries that meet in one task
LEVELS = (*(0.7 ** i for i in range(2, 20)), 0.0)  # impacts at which reading pauses, as shares of the largest one
FEW = 6  # reading ends when one in so many vectors is possible: these are scored by themselves
SEEDS = 4  # times k vectors are scored early, for a score to beat


def integers(v: Column) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: F.floor(QUANTA * x))


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``v`` (integers): no null and only finite components, of the most frequent length; of rows with one id the least vector."""
    raw = F.col("v").cast("array<double>")
    good = (table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                    & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / QUANTA)))
            .select("id", integers(F.col("v")).cast("array<int>").alias("v")))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return good.join(F.broadcast(length), F.size("v") == F.col("n")).groupBy("id").agg(F.min("v").alias("v"))


class Index:
    """Impact-ordered posting lists of a block of vectors (a row each)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.int64)
        count, self.width = vectors.shape
        size = np.abs(self.vectors)
        self.most = size.max(axis=0)
        order = np.argsort(-size, axis=0, kind="stable").T  # a list for each dimension
        self.docs = np.ascontiguousarray(order).ravel()
        self.values = np.take_along_axis(self.vectors.T, order, 1).ravel()
        self.floats = self.vectors.astype(np.float64)
        # magnitudes of all lists, falling within each: one search finds where a magnitude ends in every list
        self.step = int(self.most.max(initial=0)) + 2
        self.dims = np.arange(self.width)
        self.keys = np.repeat(self.dims, count) * self.step + (self.step - 1 - np.abs(self.values))
        self.heads = self.dims * count
        self.gains = self.values.astype(np.float64)
        self.to, self.by = np.empty(self.docs.shape, np.int64), np.empty(self.docs.shape)  # kept, as new memory costs more than reading
        self.table = None
        if self.step <= 4096:
            every = self.dims[:, None] * self.step + (self.step - 1 - np.arange(self.step)[None, :])
            self.table = np.searchsorted(self.keys, every.ravel(), side="right").reshape(self.width, self.step)
        self.usual = 0  # the pause at which reading ended for the last query

    def exact(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.width * int(self.most.max(initial=0)) * int(np.abs(query).max(initial=0)) < 1 << 52:
            return (self.floats[docs] @ query.astype(np.float64)).astype(np.int64)  # all sums are exact in doubles
        return self.vectors[docs] @ query

    def ends(self, needed: np.ndarray) -> np.ndarray:
        """Where the postings of at least these magnitudes end in each list."""
        needed = np.minimum(needed, self.step - 1)
        if self.table is not None:
            return self.table[self.dims, needed]
        return np.searchsorted(self.keys, self.dims * self.step + (self.step - 1 - needed), side="right")

    def read(self, lo: np.ndarray, hi: np.ndarray, query: np.ndarray, count: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
        """What each vector gains from the postings from ``lo`` to ``hi`` of each list, and how many of these are its own."""
        spans = [(slice(a, b), q) for a, b, q in zip(lo.tolist(), hi.tolist(), query.tolist()) if a < b]
        end = 0
        exact = unit * self.width < 1 << 52  # doubles hold every sum; a posting counts as one unit beside its gain
        for span, q in spans:
            begin, end = end, end + span.stop - span.start
            self.to[begin:end] = self.docs[span]
            np.multiply(self.gains[span] if exact else self.values[span], q, out=self.by[begin:end] if exact else self.by.view(np.int64)[begin:end])
        docs, gains = self.to[:end], self.by[:end]
        if exact:
            gains += unit
            both = np.bincount(docs, gains, count)
            seen = np.rint(both / unit)
            return both - seen * unit, seen.astype(np.int64)
        sums = np.zeros(count, np.int64)
        np.add.at(sums, docs, gains.view(np.int64))
        return sums, np.bincount(docs, minlength=count)

    def _kth(self, sums: np.ndarray, query: np.ndarray, k: int) -> int | None:
        """The k-th best exact score among the vectors with the largest sums so far."""
        some = np.argpartition(-sums, SEEDS * k)[:SEEDS * k] if SEEDS * k < len(sums) else np.arange(len(sums))
        return int(np.sort(self.exact(some, query))[-k]) if len(some) >= k else None

    def search(self, query: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Every vector that reaches the k-th best score here and ``least``: places, scores, and the number of postings read."""
        count, size = len(self.vectors), np.abs(query)
        used = np.flatnonzero(size)
        top = int((size * self.most).max(initial=0))
        unit = 4 * self.width * max(top, 1)
        sums, seen = np.zeros(count, np.int64), np.zeros(count, np.int64)
        at, read, seeded = self.heads.copy(), 0, 0
        possible = np.arange(count)
        for pause, share in enumerate(LEVELS):
            if 1 < pause < self.usual - 1:
                continue  # queries of a block are alike: look again shortly before the last one ended
            level = max(1, int(top * share))
            # all magnitudes from level / |q| on, in every dimension that the query uses
            to = np.where(size > 0, np.maximum(self.ends(-(-level // np.maximum(size, 1))), at), at)
            fresh = int((to - at).sum())
            if fresh:
                gained, own = self.read(at, to, query, count, unit)
                sums += gained.astype(np.int64)
                seen += own
                at, read = to, read + fresh
            if read >= max(count, 4 * seeded):
                seeded, own = read, self._kth(sums, query, k)
                least = max((x for x in (least, own) if x is not None), default=None)
            if least is None:
                continue
            # a vector can gain the largest unread impacts of as many dimensions as it wasn't seen in
            ahead = np.where(at < self.heads + count, size * np.abs(self.values[np.minimum(at, len(self.values) - 1)]), 0)[used]
            bound = np.concatenate(([0], np.cumsum(np.sort(ahead)[::-1])))
            possible = np.flatnonzero(sums + bound[len(used) - seen] >= least)
            if level == 1 or len(possible) <= max(1, count // FEW):
                self.usual = pause
                break  # proved: the others can't reach it
        scores = self.exact(possible, query)
        kept = np.ones(len(possible), bool) if least is None else scores >= least
        return possible[kept], scores[kept], read


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int32)


def _searched(classes: DataFrame, asked: DataFrame, queries: int, k: int) -> DataFrame:
    """``query``, ``class``, ``score``: of each block of ``classes`` what can be among the best k of a row of ``asked``.

    Both have ``id``, ``v`` and ``block``; ``asked`` has ``least``, the score to reach, or null.
    """
    parts = max(1, -(-queries // QUERIES))
    left = asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int"))
    right = classes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = right["id"].to_numpy(), left["id"].to_numpy()
        out = []
        if len(ids) and len(names):
            index = Index(_rows(right["v"]))
            for name, query, least in zip(names, _rows(left["v"]).astype(np.int64), left["least"].to_pylist(), strict=True):
                at, scores, _ = index.search(query, k, least)
                order = np.lexsort((ids[at], -scores))[:k]
                out.append((np.full(len(order), name), ids[at][order], scores[order]))
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "class", "score"])

    return (left.select("block", "part", "id", "v", "least").groupBy("block", "part")
            .cogroup(right.select("block", "part", "id", "v").groupBy("block", "part"))
            .applyInArrow(run, "query long, class long, score long"))


def search(table: DataFrame, queries: DataFrame, k: int = 20, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``table`` with the largest integer inner products for each row of ``queries``, the row itself left out.

    Returns ``query_id``, ``rank`` (from 1), the id column and ``score`` (long); ties go to the smaller id. Exact. Ids are
    integers. Null ids, vectors that are null, empty or hold null, non-finite or huge components (half a million and more,
    whose sums would leave 64 bits) and those of another length than most take no part; of rows with one id the least
    vector counts. Zero vectors take part. Equal integer vectors are one class in the index and among the queries, so
    copies add no work; a class stands for its k + 1 smallest ids. Other columns are ignored.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "impact")
    points = scratch.table(usable(table.withColumn(id_column, F.col(id_column).cast("long")), id_column, vector_column))
    grouped = points.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    total = grouped.count()
    if not total:
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score long")
    blocks = -(-total // BLOCK)
    classes = scratch.table(grouped.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    width = classes.select(F.size("v").alias("n")).first()["n"]
    asking = scratch.table(usable(queries.withColumn(id_column, F.col(id_column).cast("long")), id_column, vector_column)
                           .filter(F.size("v") == width))
    asked = scratch.table(asking.groupBy("v").agg(F.min("id").alias("id")))
    count = asked.count()

    first = scratch.table(_searched(classes.filter("block = 0"), asked.withColumns({"block": F.lit(0), "least": F.lit(None).cast("long")}), count, k + 1))
    found = first
    if blocks > 1:
        reached = (first.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("least")))
        others = (asked.join(reached.withColumnRenamed("query", "id"), "id", "left")
                  .withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1)))))
        found = first.unionByName(scratch.table(_searched(classes.filter("block > 0"), others, count, k + 1)))
    best = pick(found, ["query"], [F.desc("score"), F.asc("class")], k + 1)
    members = points.join(classes.filter("n > 1").select("v", F.col("id").alias("class")), "v").select("class", "id")
    smallest = pick(members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256))), ["class", "salt"], [F.asc("id")], k + 1)
    smallest = pick(smallest.select("class", "id"), ["class"], [F.asc("id")], k + 1).groupBy("class").agg(F.collect_list("id").alias("ids"))
    rows = (best.join(smallest, "class", "left")
            .select("query", "score", F.explode(F.coalesce("ids", F.array("class"))).alias("id")))
    rows = pick(rows, ["query"], [F.desc("score"), F.asc("id")], k + 1)
    named = asking.join(asked.withColumnRenamed("id", "query"), "v").select("query", F.col("id").alias("query_id"))
    answer = named.join(rows, "query").filter("query_id <> id")
    return (top_per_group(answer, ["query_id"], [F.desc("score"), F.asc("id")], k)
            .select("query_id", "rank", F.col("id").alias(id_column), "score"))
