"""Exact top-k neighbours by shared features, without pairing up hot features.

Two entities are related when they share features (users sharing items, items
sharing tags). Joining a feature's members with each other costs members², which
a feature held by a third of all entities makes impossible. Features are split:

* light features (at most ``heavy`` members) send the list of their members to
  each member; lists are taken apart and counted where those of an entity meet,
  at most ``heavy`` rows per input row, so pairs themselves are not shuffled;
* heavy features are never joined member by member. The sets of heavy features go
  through a set-similarity search: rarest features first, until the features that
  remain can't reach the running k-th score (with the bound that sizes put on a
  Jaccard score), in tiles of bounded size, equal sets as one (``sparse.py``). Its
  best ``k`` by heavy features alone are enough: a pair that shares no light
  feature and isn't among them has ``k`` partners before it.

Pairs of both parts get their whole overlap, and the best ``k`` of these are the
exact result; nothing is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.operators.relational import pick
from wayfunnel.operators.sparse import sparse_topk
from wayfunnel.session import written

HEAVY_MEMBERS = 1000
TASK_PAIRS = 1_000_000  # that a task takes apart and counts, about, so that they fit its memory

Score = Callable[[Column, Column, Column], Column]


def overlap_count(common: Column, left: Column, right: Column) -> Column:
    return common.cast("double")


def jaccard(common: Column, left: Column, right: Column) -> Column:
    return common / (left + right - common)


def _rows() -> Column:
    return F.count(F.lit(1))


def shared_feature_topk(pairs: DataFrame, entity: str, feature: str, k: int, score: Score = overlap_count,
                        min_common: int = 1, heavy: int = HEAVY_MEMBERS) -> DataFrame:
    """(src, dst, common, score, rank): the ``k`` best partners by score, then id.

    ``score`` is ``overlap_count`` or ``jaccard``.
    """
    base = pairs.select(F.col(entity).alias("e"), F.col(feature).alias("f")) \
        .filter("e is not null and f is not null").distinct()
    members = base.groupBy("f").agg(_rows().alias("n"))
    entities = base.groupBy("e").agg(_rows().alias("size"))
    has_heavy = bool(members.filter(F.col("n") > heavy).limit(1).count())

    light = base
    if has_heavy:
        light = base.join(members.filter(F.col("n") <= heavy), "f", "left_semi")
    sized = score is jaccard and not has_heavy  # pairs that carry the sizes of both need no further join
    if sized:
        light = light.join(entities, "e")
    pairs_met = members.filter(F.col("n") <= heavy).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    found = _light_pairs(light, sized, max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs_met / TASK_PAIRS)))
    if sized:
        common, left, right = F.col("common"), F.col("size_src"), F.col("size_dst")
    elif not has_heavy:
        common, left, right = F.col("common"), F.lit(0), F.lit(0)
    else:
        sets = base.join(members.filter(F.col("n") > heavy), "f", "left_semi") \
            .groupBy("e").agg(F.sort_array(F.collect_list(F.xxhash64("f"))).alias("hot"))
        entities = written(entities.join(sets, "e", "left"), "overlap-entities")
        best = _by_heavy(entities.filter("hot is not null"), k, score is jaccard, min_common)
        found = found.unionByName(best.select("src", "dst", F.lit(0).alias("common"))).groupBy("src", "dst").agg(F.sum("common").alias("common"))

        def side(name: str) -> DataFrame:
            return entities.select(F.col("e").alias(name), F.col("size").alias(f"size_{name}"), F.col("hot").alias(f"hot_{name}"))

        none = F.array().cast("array<bigint>")
        found = found.join(side("src"), "src").join(side("dst"), "dst")
        shared = F.size(F.array_intersect(F.coalesce("hot_src", none), F.coalesce("hot_dst", none)))
        common, left, right = F.col("common") + shared, F.col("size_src"), F.col("size_dst")
    scored = found.select("src", "dst", common.alias("common"), left.alias("l"), right.alias("r")).filter(F.col("common") >= min_common) \
        .select("src", "dst", "common", score(F.col("common"), F.col("l"), F.col("r")).alias("score"))
    return ranked(scored, k)


def _light_pairs(light: DataFrame, sized: bool, tasks: int) -> DataFrame:
    """(src, dst, common; ``sized``: size_src, size_dst) of all pairs that share features (``e``, ``f``, ``sized``: ``size``).

    A feature's members travel as one list, of bounded length, to each of them; lists are taken apart only where all those
    of a source meet, so no pair is shuffled.
    """
    extra = ["size"] if sized else []
    lists = light.groupBy("f").agg(F.collect_list(F.struct("e", *extra)).alias("others"))
    met = light.join(lists, "f").filter(F.size("others") > 1).select(F.col("e").alias("src"), *[F.col(c).alias("size_src") for c in extra], "others")
    pairs = met.repartition(tasks, "src").select("src", *[f"size_{c}" for c in ("src",) if sized], F.explode("others").alias("o"))
    pairs = pairs.select("src", F.col("o.e").alias("dst"), *(["size_src", F.col("o.size").alias("size_dst")] if sized else [])).filter("src <> dst")
    sizes = [F.max(c).alias(c) for c in ("size_src", "size_dst")] if sized else []
    return pairs.groupBy("src", "dst").agg(_rows().alias("common"), *sizes)


def _by_heavy(sets: DataFrame, k: int, jaccard_score: bool, min_common: int) -> DataFrame:
    """The best ``k`` partners by heavy features alone (``e``, ``size``, ``hot``)."""
    points = sets.select(F.col("e").alias("id"), F.col("hot").alias("idx"), F.transform("hot", lambda x: F.lit(1.0)).alias("val"), "size")
    if jaccard_score:
        return sparse_topk(points, k, 0.0, common=float(min_common))
    return sparse_topk(points.drop("size"), k, float(min_common))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    from wayfunnel.operators.relational import top_per_group
    return top_per_group(scored, ["src"], [F.desc("score"), F.asc("dst")], k)


def same_group_topk(df: DataFrame, entity: str, group: Column, k: int) -> DataFrame:
    """The ``k`` smallest ids of the same group with score 1: only ``k + 1`` members per
    group are joined, so a group of any size costs ``k + 1`` rows per entity."""
    keyed = df.select(F.col(entity).alias("src"), group.alias("g")).filter("g is not null").distinct()
    offered = pick(keyed.select("g", F.col("src").alias("dst")), ["g"], [F.asc("dst")], k + 1)
    scored = keyed.join(offered, "g").filter("src <> dst").select("src", "dst", F.lit(1.0).alias("score"))
    return ranked(scored, k)
