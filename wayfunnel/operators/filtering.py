"""Collaborative filtering: neighbour models, factor models, ensembles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions.common import zero
from wayfunnel.operators.nearest import DIGITS
from wayfunnel.operators.overlap import HEAVY_MEMBERS, TASK_PAIRS
from wayfunnel.operators.relational import outer_union, top_per_group
from wayfunnel.operators.sparse import BLOCK, sparse_topk
from wayfunnel.session import written

# Neighbours per prediction, rating range, factor settings, cold-start limit, ensemble weights.
NEIGHBOURS, LOW, HIGH, COLD_RATINGS = 10, 0.0, 5.0, 5
FACTORS, EPOCHS = 50, 20
ENSEMBLE = {"user_cf": 0.4, "content": 0.3, "popularity": 0.3}
LISTED = 1000  # cells of a list that travels as one value, about


def rows() -> Column:
    return F.count(F.lit(1))


def cosine_neighbours(ratings: DataFrame, entity: str, feature: str, k: int = NEIGHBOURS, value: str = "rating",
                      heavy: int = HEAVY_MEMBERS, block: int = BLOCK) -> DataFrame:
    """Top-k cosine partners over sparse rating vectors: (src, dst, score, rank).

    Without features held by more than ``heavy`` entities a feature's members travel as one list to each of them,
    and products are summed where all lists of a source meet, so no pair is shuffled. Otherwise this would pair up
    the members of a hot feature, so vectors go through inverted indexes of bounded size (exact as well).
    """
    base = ratings.groupBy(F.col(entity).alias("e"), F.col(feature).alias("f")).agg(F.sum(value).alias("v")) \
        .filter("v <> 0")
    lengths = base.groupBy("e").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    unit = base.join(lengths, "e").select("e", "f", (F.col("v") / F.col("l")).alias("v"))
    crowded = base.groupBy("f").agg(rows().alias("n")).filter(F.col("n") > heavy).limit(1).count()
    if crowded:
        vectors = unit.groupBy(F.col("e").cast("long").alias("id")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("f").cast("long").alias("f"), "v"))).alias("c")).select(
            "id", F.transform("c", lambda x: x["f"]).alias("idx"), F.transform("c", lambda x: x["v"]).alias("val"))
        return sparse_topk(vectors, k, 0.0, strict=True, block=block)
    met = base.groupBy("f").agg(rows().alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    others = unit.groupBy("f").agg(F.collect_list(F.struct(F.col("e").alias("dst"), F.col("v").alias("y"))).alias("others"))
    sent = unit.select("f", F.col("e").alias("src"), F.col("v").alias("x")).join(others.filter(F.size("others") > 1), "f")
    pairs = sent.select("src", "x", "others").repartition(_tasks(ratings, met), "src").select("src", "x", F.inline("others"))
    scored = pairs.filter("src <> dst").groupBy("src", "dst").agg(F.round(F.sum(F.col("x") * F.col("y")), DIGITS).alias("score"))
    return top_per_group(scored.filter("score > 0"), ["src"], [F.desc("score"), F.asc("dst")], k)


def user_based(ratings: DataFrame, neighbours: DataFrame, n: int) -> DataFrame:
    """Best unseen items by the similarity-weighted mean rating of the neighbours who rated them."""
    listed = _lists(ratings, "user_id", "item_id", F.struct("item_id", "rating"))
    offered = neighbours.select(F.col("src").alias("user_id"), F.col("dst").alias("other"), "score") \
        .join(listed.withColumnRenamed("user_id", "other"), "other")
    return _weighted(offered.select("user_id", F.col("score").alias("x"), "cells"), F.col("x"), F.col("rating"), ratings, n)


def item_based(ratings: DataFrame, neighbours: DataFrame, n: int) -> DataFrame:
    """The same with the neighbours of the items a user rated."""
    listed = _lists(neighbours, "dst", "src", F.struct(F.col("src").alias("item_id"), "score"))
    offered = ratings.select("user_id", F.col("item_id").alias("dst"), "rating").join(listed, "dst")
    return _weighted(offered.select("user_id", F.col("rating").alias("x"), "cells"), F.col("score"), F.col("x"), ratings, n)


def _tasks(df: DataFrame, cells: int) -> int:
    """Tasks that take apart and sum about ``TASK_PAIRS`` of the cells each."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / TASK_PAIRS))


def _lists(df: DataFrame, key: str, other: str, cell: Column) -> DataFrame:
    """(``key``, cells): the cells of a key in lists of about ``LISTED``; a key with more has several."""
    parts = F.ceil(rows().over(Window.partitionBy(key)) / F.lit(LISTED))
    return df.withColumn("part", F.pmod(F.xxhash64(other), parts)).groupBy(key, "part").agg(F.collect_list(cell).alias("cells")).drop("part")


def _met(offered: DataFrame, own: DataFrame, value: str, tasks: int) -> DataFrame:
    """(user_id, x, own, item_id, ``value``): the cells of the offered lists in the task of their user, where the user's ``own``
    items come as cells without a value."""
    none = F.lit(None).cast("double")
    mine = own.filter("user_id is not null and item_id is not null") \
        .select("user_id", none.alias("x"), F.array(F.struct("item_id", none.alias(value))).alias("cells"))
    return offered.withColumn("own", F.lit(0)).unionByName(mine.withColumn("own", F.lit(1))).repartition(tasks, "user_id") \
        .select("user_id", "x", "own", F.inline("cells"))


def _weighted(offered: DataFrame, score: Column, rating: Column, ratings: DataFrame, n: int) -> DataFrame:
    """Lists (user_id, x, cells) travel whole to their user and are taken apart there, where the user's own items are left out;
    neither sums nor seen pairs are shuffled."""
    name = next(f.name for f in offered.schema["cells"].dataType.elementType.fields if f.name != "item_id")
    cells = _met(offered, ratings, name, _tasks(ratings, ratings.count() * (NEIGHBOURS + 1)))
    means = cells.groupBy("user_id", "item_id").agg(
        F.round(F.sum(score * rating) / F.sum(score), DIGITS).alias("prediction"), F.max("own").alias("own"))
    return top_per_group(means.filter("own = 0").drop("own"), ["user_id"], [F.desc("prediction"), F.asc("item_id")], n)


def predict(pairs: DataFrame, ratings: DataFrame, neighbours: DataFrame) -> DataFrame:
    """User-based prediction of given (user, item) pairs; a known rating is returned as it is. A neighbour's ratings travel as lists."""
    known = ratings.select("user_id", "item_id", F.col("rating").alias("known"))
    listed = _lists(ratings, "user_id", "item_id", F.struct("item_id", "rating"))
    offered = neighbours.select(F.col("src").alias("user_id"), F.col("dst").alias("other"), "score") \
        .join(listed.withColumnRenamed("user_id", "other"), "other").select("user_id", F.col("score").alias("x"), "cells")
    met = _met(offered, pairs, "rating", _tasks(ratings, ratings.count() * (NEIGHBOURS + 1)))
    sums = met.groupBy("user_id", "item_id").agg(F.sum(F.col("x") * F.col("rating")).alias("s"), F.sum("x").alias("w"), F.max("own").alias("own"))
    guessed = sums.filter("own = 1").select("user_id", "item_id", (F.col("s") / F.col("w")).alias("guess"))
    return pairs.join(known, ["user_id", "item_id"], "left").join(guessed, ["user_id", "item_id"], "left") \
        .select("user_id", "item_id", F.coalesce("known", "guess", F.lit(0.0)).alias("prediction"))


def predict_by_items(pairs: DataFrame, ratings: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Item-based prediction of given (user, item) pairs from the user's ratings of similar items; a known rating is returned as it is."""
    known = ratings.select("user_id", "item_id", F.col("rating").alias("known"))
    near = neighbours.select(F.col("src").alias("item_id"), F.col("dst").alias("other"), "score")
    guessed = pairs.join(near, "item_id").join(ratings.select("user_id", F.col("item_id").alias("other"), "rating"), ["user_id", "other"]) \
        .groupBy("user_id", "item_id").agg((F.sum(F.col("score") * F.col("rating")) / F.sum("score")).alias("guess"))
    return pairs.join(known, ["user_id", "item_id"], "left").join(guessed, ["user_id", "item_id"], "left") \
        .select("user_id", "item_id", F.coalesce("known", "guess", F.lit(0.0)).alias("prediction"))


def clip(c: Column | str) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col(c) if isinstance(c, str) else c))


def factorise(ratings: DataFrame, rank: int = FACTORS, iterations: int = 10, reg: float = 0.1, seed: int = 42):
    from pyspark.ml.recommendation import ALS
    return ALS(rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol="user_id", itemCol="item_id",
               ratingCol="rating", coldStartStrategy="drop", checkpointInterval=-1).fit(
        ratings.select("user_id", "item_id", F.col("rating").cast("float").alias("rating")))


def recommend_factors(model, n: int) -> DataFrame:
    flat = model.recommendForAllUsers(n).select("user_id", F.posexplode("recommendations").alias("p", "r"))
    return flat.select("user_id", F.col("r.item_id").alias("item_id"), clip(F.col("r.rating").cast("double")).alias("prediction"),
                       (F.col("p") + 1).alias("rank"))


def truncated_svd(ratings: DataFrame, rank: int = 20, rounds: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Leading singular factors by subspace iteration: (user_id, u), (item_id, v) with u·v the approximation.

    Every round is two joins with map-side sums; only rank × rank matrices reach the driver.
    """
    cells = ratings.select("user_id", "item_id", "rating")

    def sums(side: DataFrame, key: str, by: str) -> DataFrame:
        joined = cells.join(side, by)
        packed = joined.groupBy(key).agg(*[F.sum(F.col("rating") * F.col("q")[i]).alias(f"s{i}") for i in range(rank)])
        return packed.select(key, F.array(*[F.col(f"s{i}") for i in range(rank)]).alias("q"))

    def gram(side: DataFrame) -> np.ndarray:
        pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
        row = side.agg(F.array(*[F.sum(F.col("q")[i] * F.col("q")[j]) for i, j in pairs]).alias("g")).first()
        g = np.zeros((rank, rank))
        for (i, j), x in zip(pairs, row["g"]):
            g[i, j] = g[j, i] = x
        return g

    def times(side: DataFrame, m: np.ndarray) -> DataFrame:
        key = [c for c in side.columns if c != "q"][0]
        return side.select(key, F.array(*[sum((F.col("q")[i] * float(m[i, j]) for i in range(rank)), F.lit(0.0))
                                          for j in range(rank)]).alias("q"))

    def orthonormal(side: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(side))
        scale = np.where(values > 1e-10 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        return times(side, vectors * scale[None, :])

    start = cells.select("item_id").distinct().select("item_id", F.array(*[
        (F.pmod(F.xxhash64("item_id", F.lit(seed + i)), F.lit(2001)) - 1000) / 1000.0 for i in range(rank)]).alias("q"))
    q = orthonormal(written(start, "svd-start"))
    for i in range(rounds):
        p = written(sums(q, "user_id", "item_id"), f"svd-users-{i}")
        q = orthonormal(written(sums(p, "item_id", "user_id"), f"svd-items-{i}"))
    users = sums(q, "user_id", "item_id")
    return users.withColumnRenamed("q", "u"), q.withColumnRenamed("q", "v")


def factor_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    from wayfunnel.functions.vectors import dot
    return pairs.join(users, "user_id").join(items, "item_id").select("user_id", "item_id", clip(dot("u", "v")).alias("prediction"))


def ensemble(tables: Mapping[str, DataFrame], n: int, weights: Mapping[str, float] = ENSEMBLE) -> DataFrame:
    """Weighted sum over model outputs (user_id, item_id, score) with the weighted score of each model as a map."""
    parts = [t.select("user_id", "item_id", F.lit(name).alias("m"), F.col("score").alias("s"), F.lit(weights[name]).alias("w"))
             for name, t in tables.items()]
    total = outer_union(parts).groupBy("user_id", "item_id").agg(
        F.round(F.sum(F.col("s") * F.col("w")), DIGITS).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("m", F.round(F.col("s") * F.col("w"), DIGITS).alias("s"))))).alias("model_scores"))
    return top_per_group(total, ["user_id"], [F.desc("score"), F.asc("item_id")], n)


def meta_features(pairs: DataFrame, predictions: Sequence[tuple[str, DataFrame]], ratings: DataFrame) -> DataFrame:
    """Base predictions and user / item mean, deviation and count of the ratings."""
    out = pairs
    for name, p in predictions:
        out = out.join(p.select("user_id", "item_id", F.col("prediction").alias(name)), ["user_id", "item_id"], "left")
    for key, prefix in (("user_id", "user"), ("item_id", "item")):
        stats = ratings.groupBy(key).agg(F.avg("rating").alias(f"{prefix}_mean"), zero(F.stddev_samp("rating")).alias(f"{prefix}_std"),
                                         rows().alias(f"{prefix}_count"))
        out = out.join(stats, key, "left")
    return out.na.fill(0.0)


def meta_model(train: DataFrame, features: Sequence[str], label: str = "rating", seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            GBTRegressor(labelCol=label, maxIter=20, maxDepth=4, seed=seed)]).fit(train)


def switch(ratings: DataFrame, users: DataFrame, content: DataFrame, collaborative: DataFrame,
           cold: int = COLD_RATINGS) -> DataFrame:
    """Content lists for users with few ratings, collaborative lists for the others."""
    counted = users.select("user_id").distinct().join(ratings.groupBy("user_id").agg(rows().alias("n")), "user_id", "left")
    kind = counted.select("user_id", F.when(zero("n") < cold, "content").otherwise("collaborative").alias("algorithm"))
    both = content.select("user_id", "item_id", "score", F.lit("content").alias("algorithm")).unionByName(
        collaborative.select("user_id", "item_id", "score", F.lit("collaborative").alias("algorithm")))
    return both.join(kind, ["user_id", "algorithm"], "left_semi")
