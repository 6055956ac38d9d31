"""Exact nearest neighbours over vectors, in bounded blocks.

Points are assigned to a few hundred pivots and each pivot's points are salted
into blocks of about ``block_rows`` rows, so copies of one vector do not pile up
in one task. Every query first searches one block of its own pivot, which gives a
score to beat; then it visits only pivots that can still hold something better
(triangle inequality on the distance to the pivot). For that the pivots are laid
into tiles, larger than blocks, and a query is sent once to each tile that holds
such a pivot and leaves it with its best ``k``, so what is shuffled follows the
number of tiles and not that of blocks. Spark does the grouping and shuffling;
inside a task there are numpy products of bounded slices.

Points: (id long, val array<double>). Sparse rows have ``operators/sparse.py``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.functions import vectors as vec
from wayfunnel.operators.relational import top_per_group
from wayfunnel.operators.sparse import packed, side_of
from wayfunnel.session import written

DIGITS = 9          # scores closer than this are ties, broken by id
SLACK = 1e-6        # rounding allowance of the pruning test
BLOCK_ROWS, MAX_PIVOTS = 2048, 256
TILE_ROWS = 32768   # on each side of a tile, at most
SLICES = {"cosine": (1024, 4096), "cityblock": (256, 4096)}  # queries and members that are compared at a time


def dense_points(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("val"))


def unit_points(df: DataFrame, key: str, column: str) -> DataFrame:
    """Dense points scaled to length 1; zero vectors have no direction and are left out."""
    kept = df.filter(vec.norm(column) > 0)
    return dense_points(kept.withColumn("_unit", vec.normalised(column)), key, "_unit")


def _matrix(val: pd.Series) -> np.ndarray:
    return np.stack(val.to_numpy()).astype(np.float64)


def _scores(queries: np.ndarray, members: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return queries @ members.T
    return 1.0 / (1.0 + np.abs(queries[:, None, :] - members[None, :, :]).sum(axis=2))


def _distance(score: np.ndarray, metric: str) -> np.ndarray:
    """Distance with a triangle inequality: angle, or city-block length."""
    if metric == "cosine":
        return np.arccos(np.clip(score, -1.0, 1.0))
    return 1.0 / score - 1.0


def _best(queries: np.ndarray, asked: np.ndarray, floor: np.ndarray, members: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int,
          metric: str, min_score: float, strict: bool, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the best ``k`` for some queries with their ``floor`` among slices (ids in order, vectors, who visits)."""
    bar = np.maximum(floor, min_score) - SLACK
    rows, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for ids, there, visiting in members:
        who = np.flatnonzero(visiting)
        if not len(who):
            continue
        s = _scores(queries[who], there, metric)
        if exclude_self:
            place = np.minimum(np.searchsorted(ids, asked[who]), len(ids) - 1)
            own = np.flatnonzero(ids[place] == asked[who])
            s[own, place[own]] = -np.inf
        good = s >= bar[who, None]
        many = np.flatnonzero(good.sum(axis=1) > 4 * k)
        if len(many):
            kth = np.partition(s[many], s.shape[1] - k, axis=1)[:, -k]
            good[many] = s[many] >= np.maximum(bar[who[many]], kth - SLACK)[:, None]
            tied = many[good[many].sum(axis=1) > 4 * k]  # copies: the smallest ids of the best
            if len(tied):
                first = np.argsort(-np.round(s[tied], DIGITS), axis=1, kind="stable")[:, :k]
                good[tied] = False
                good[tied[:, None], first] = True
        r, c = np.nonzero(good)
        if not len(r):
            continue
        rows, found = np.concatenate([rows, who[r]]), np.concatenate([found, ids[c]])
        scores = np.concatenate([scores, np.round(s[r, c], DIGITS)])
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        starts = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - starts < k
        last = np.flatnonzero(np.arange(len(rows)) - starts == k - 1)
        bar[rows[last]] = np.maximum(bar[rows[last]], scores[last] - SLACK)
        rows, found, scores = rows[kept], found[kept], scores[kept]
    kept = scores > min_score if strict else scores >= min_score
    return rows[kept], found[kept], scores[kept]


def nearest(points: DataFrame, k: int, metric: str = "cosine", min_score: float = -math.inf, strict: bool = False,
            queries: DataFrame | None = None, exclude_self: bool = True,
            block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(src, dst, score, rank) with the ``k`` best points per query by score, then id.

    ``metric`` is ``cosine`` (unit vectors expected) or ``cityblock`` (score 1/(1+distance)).
    """
    spark = points.sparkSession
    total = points.count()
    wanted = max(1, min(max_pivots, math.ceil(total / block_rows)))
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()  # at most max_pivots rows
    if chosen.empty:
        return spark.createDataFrame([], "src long, dst long, score double, rank int")
    pivots = _matrix(chosen["val"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distance(_scores(_matrix(pdf["val"]), pivots, metric), metric)
            best = d.argmin(axis=1)
            yield pdf.assign(pivot=best.astype(np.int32), dist=d[np.arange(len(pdf)), best])

    schema = "id long, val array<double>, pivot int, dist double"
    one_block = wanted == 1 and total <= block_rows

    def assigned(df: DataFrame) -> DataFrame:
        if one_block:
            return df.withColumns({"pivot": F.lit(0), "dist": F.lit(0.0)})
        return written(df.mapInPandas(assign, schema), "assigned")

    members = assigned(points)
    asked = members if queries is None else assigned(queries)
    if one_block:
        radius, sizes = {0: math.pi}, [(0, total)]
    else:
        stats = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()
        radius = {r["pivot"]: float(r["r"]) for r in stats}          # at most max_pivots rows
        sizes = sorted((r["pivot"], r["n"]) for r in stats)
    names = np.array([p for p, _ in sizes], dtype=np.int32)
    reach = np.array([radius[p] for p in names])

    def matched(asks: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
        """Queries (with ``bound``) against members (with ``pivot``) of the same keys."""
        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            src, dst, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if len(left) and len(right):
                right = right.sort_values("m_pivot")
                parts = []
                for at in range(0, len(right), SLICES[metric][1]):
                    part = right.iloc[at:at + SLICES[metric][1]].sort_values("m_id")
                    parts.append((part["m_id"].to_numpy(), _matrix(part["m_val"]), np.searchsorted(names, part["m_pivot"].unique())))
                asked_ids, floors = left["id"].to_numpy(), left["bound"].astype("float64").fillna(-np.inf).to_numpy()
                step = SLICES[metric][0]
                for at in range(0, len(left), step):
                    q, mine, floor = _matrix(left["val"].iloc[at:at + step]), asked_ids[at:at + step], floors[at:at + step]
                    keep = np.ones((len(q), len(names)), bool) if one_block else possible(q, floor)
                    r, found, s = _best(q, mine, floor, [(i, v, keep[:, p].any(axis=1)) for i, v, p in parts], k, metric, min_score, strict, exclude_self)
                    src.append(mine[r])
                    dst.append(found)
                    score.append(s)
            return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "score": np.concatenate(score)})

        # both sides stem from one table, so the right side gets names of its own
        right = there.select(*[F.col(c).alias(f"m_{c}") for c in (*keys, "pivot", "id", "val")] if "pivot" not in keys else
                             [F.col(c).alias(f"m_{c}") for c in (*keys, "id", "val")]).groupBy(*[f"m_{c}" for c in keys])
        return asks.select(*keys, "id", "val", "bound").groupBy(*keys).cogroup(right).applyInPandas(best, "src long, dst long, score double")

    def possible(q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which pivots can still hold something that reaches the score to beat."""
        floor = np.maximum(floor, min_score)
        none = np.isinf(floor) & (floor < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = np.where(none | ((floor <= 0) & (metric == "cityblock")), np.inf, _distance(np.where(none, 1.0, floor), metric))
        return _distance(_scores(q, pivots[names], metric), metric) - reach[None, :] <= limit[:, None] + SLACK

    tasks = spark.sparkContext.defaultParallelism
    if one_block:
        bounded = asked.withColumn("bound", F.lit(None).cast("double"))
        return _cut(matched(bounded, members, ["pivot"]), k)

    # the first visit: a block of the own pivot
    salts = spark.createDataFrame([(p, max(1, math.ceil(n / block_rows))) for p, n in sizes], "pivot int, salts int")
    salted = F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt")
    blocks = members.join(F.broadcast(salts), "pivot").select("id", "val", "pivot", salted)
    asks = asked.join(F.broadcast(salts), "pivot").select("id", "val", "pivot", salted, F.lit(None).cast("double").alias("bound"))
    if queries is not None:  # more queries than members of a block are dealt out
        chunks = asks.groupBy("pivot", "salt").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(block_rows, BLOCK_ROWS))).cast("int").alias("chunks"))
        asks = asks.join(F.broadcast(chunks), ["pivot", "salt"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), "chunks").cast("int"))
        blocks = blocks.join(F.broadcast(chunks), ["pivot", "salt"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["pivot", "salt"] if queries is None else ["pivot", "salt", "chunk"]
    bounds = written(matched(asks, blocks, keys).groupBy(F.col("src").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound")), "first-visit")

    # all that can be better: tiles of pivots, each query once for a tile
    plan = packed(sizes, side_of(total, TILE_ROWS, tasks))
    tiles = spark.createDataFrame(plan, "pivot int, first int, parts int")
    home = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts"))).cast("int").alias("tile")
    placed = members.join(F.broadcast(tiles), "pivot").select("id", "val", "pivot", home)
    spans = {pivot: range(first, first + parts) for pivot, first, parts in plan}
    count = plan[-1][1] + plan[-1][2]
    to_tile = np.zeros((len(names), count), bool)
    for i, p in enumerate(names.tolist()):
        to_tile[i, list(spans[p])] = True

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                floor = pdf["bound"].astype("float64").fillna(-np.inf).to_numpy()
                keep = possible(_matrix(pdf["val"]), floor) @ to_tile
                yield pd.DataFrame({"id": pdf["id"], "val": pdf["val"], "bound": pdf["bound"], "tiles": [np.flatnonzero(x).astype(np.int32) for x in keep]})

    side = side_of(total, TILE_ROWS, tasks)
    routed = asked.join(bounds, "id", "left").select("id", "val", "bound") \
        .mapInPandas(route, "id long, val array<double>, bound double, tiles array<int>")
    sent = routed.select("id", "val", "bound", F.explode("tiles").alias("tile"))
    if (total if queries is None else asked.count()) <= side:
        lines = F.lit(1)
    else:  # as many lines as the queries of a tile need, as each line gets all members of the tile
        sent = written(routed, "routed").select("id", "val", "bound", F.explode("tiles").alias("tile"))
        asking = F.broadcast(sent.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(side)).cast("int").alias("lines")))  # a row for each tile
        sent, placed, lines = sent.join(asking, "tile"), placed.join(asking, "tile"), F.col("lines")
    routed = sent.select("id", "val", "bound", "tile", F.pmod(F.xxhash64("id", F.lit(7)), lines).cast("int").alias("line"))
    there = placed.withColumn("line", F.explode(F.sequence(F.lit(0), lines - 1)))
    return _cut(matched(routed, there, ["tile", "line"]), k)


def _cut(found: DataFrame, k: int) -> DataFrame:
    return top_per_group(found, ["src"], [F.desc("score"), F.asc("dst")], k)
