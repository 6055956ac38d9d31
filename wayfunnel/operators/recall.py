"""Candidate tables: neighbours of items and users, channel quotas and merging."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions import vectors as vec
from wayfunnel.functions.common import bucket_of, col, ratio, scalar, split_tags, zero
from wayfunnel.operators import nearest as nn
from wayfunnel.operators import textsim as ts
from wayfunnel.operators.overlap import HEAVY_MEMBERS, TASK_PAIRS, jaccard, ranked, same_group_topk, shared_feature_topk
from wayfunnel.operators.relational import outer_union, pick, top_overall, top_per_group
from wayfunnel.operators.sparse import sparse_topk

# Price edges, image weight, popular-list limits, merge weights and event weights.
PRICE_EDGES = (100.0, 500.0, 1000.0, 5000.0)
IMAGE_WEIGHT = 0.4
MIN_SCORE = 0.01
POPULAR = {"min_price": 0.5, "min_interaction": 10, "max_inactive_days": 730, "pool": 3, "alert_ratio": 0.7}
MERGE_WEIGHTS: dict[str, float] = {"behavior": 1.0, "content": 0.5, "vector_faiss": 0.7, "usercf": 0.8, "tag": 0.6,
                                   "category": 0.4, "price": 0.3, "image": 0.5, "popular": 0.1}
UNLISTED_WEIGHT = 0.5
CHANNEL_ORDER = ("behavior", "content", "usercf", "tag", "category", "price", "image", "vector_faiss", "popular")
CHANNEL_QUOTA = {c: (8 if c in ("image", "popular") else 7) for c in CHANNEL_ORDER}
VIEW_WEIGHT, CLICK_WEIGHT = 1, 3
LIST_ROWS = 1000  # items of a user that travel as one list, about


def rows() -> Column:
    return F.count(F.lit(1))


def behaviour_neighbours(interactions: DataFrame, k: int, heavy: int = HEAVY_MEMBERS) -> DataFrame:
    """Items taken by the same users; kept counts of a source item sum to 1."""
    found = shared_feature_topk(interactions, "dataset_id", "user_id", k, heavy=heavy)
    total = F.sum("common").over(Window.partitionBy("src"))  # at most k rows per source
    return found.select("src", "dst", (F.col("common") / total).alias("score"), "rank")


def user_neighbours(interactions: DataFrame, min_common: int = 2, k: int = 50, heavy: int = HEAVY_MEMBERS) -> DataFrame:
    return shared_feature_topk(interactions, "user_id", "dataset_id", k, jaccard, min_common, heavy) \
        .select("src", "dst", "score", "rank")


def user_candidates(neighbours: DataFrame, interactions: DataFrame, k: int) -> DataFrame:
    """Items of similar users that the user has not taken, by summed similarity.

    A similar user's items travel as lists of bounded length, and the user's own ones beside them, so neither offered rows
    nor the ones to leave out are shuffled one by one.
    """
    taken = interactions.select("user_id", "dataset_id").distinct()
    sizes = taken.groupBy("user_id").agg(rows().alias("n"))
    salt = F.pmod(F.xxhash64("dataset_id"), F.ceil(F.col("n") / F.lit(LIST_ROWS)))
    lists = taken.join(sizes, "user_id").groupBy("user_id", salt.alias("salt")).agg(F.collect_list("dataset_id").alias("items"))
    similar = neighbours.select("src", F.col("dst").alias("user_id"), "score").filter("score is not null")
    offered = similar.join(sizes, "user_id").agg(F.sum("n")).first()[0] or 0
    tasks = max(neighbours.sparkSession.sparkContext.defaultParallelism, math.ceil(offered / TASK_PAIRS))
    given = similar.join(lists, "user_id").select("src", "score", "items")
    own = lists.select(F.col("user_id").alias("src"), F.lit(None).cast("double").alias("score"), "items")
    met = given.unionByName(own).repartition(tasks, "src")
    summed = met.select(F.col("src").alias("user_id"), "score", F.explode("items").alias("dataset_id")).groupBy("user_id", "dataset_id") \
        .agg(F.round(F.sum("score"), nn.DIGITS).alias("score"), F.count_if(F.col("score").isNull()).alias("own"))
    return top_per_group(summed.filter("own = 0").drop("own"), ["user_id"], [F.desc("score"), F.asc("dataset_id")], k)


def tag_index(items: DataFrame) -> DataFrame:
    return items.select(F.explode(split_tags("tag")).alias("tag"), "dataset_id").distinct()


def tag_neighbours(items: DataFrame, k: int, heavy: int = HEAVY_MEMBERS) -> DataFrame:
    return shared_feature_topk(tag_index(items), "dataset_id", "tag", k, jaccard, 1, heavy) \
        .select("src", "dst", "score", "rank")


def category_index(items: DataFrame, column: str = "create_company_name") -> DataFrame:
    named = F.nullif(F.lower(F.col(column)), F.lit(""))
    return items.select(named.alias("category"), "dataset_id").filter("category is not null")


def category_neighbours(items: DataFrame, k: int, column: str = "create_company_name") -> DataFrame:
    return same_group_topk(items, "dataset_id", F.nullif(F.lower(F.col(column)), F.lit("")), k)


def price_bucket(c: Column | str = "price") -> Column:
    return bucket_of(F.coalesce(col(c), F.lit(0.0)), PRICE_EDGES, False).cast("int")


def price_neighbours(items: DataFrame, k: int) -> DataFrame:
    return same_group_topk(items, "dataset_id", price_bucket(), k)


def image_neighbours(features: DataFrame, k: int, block_rows: int = nn.BLOCK_ROWS) -> DataFrame:
    """Items with the closest picture richness and count: score 1/(1 + |Δrichness| + 0.1·|Δcount|).
    Items without pictures get the richest ones instead (richness above 0.5)."""
    shown = features.filter("has_images = 1")
    point = F.array(F.col("image_richness_score").cast("double"), F.col("image_count").cast("double") * 0.1)
    close = nn.nearest(nn.dense_points(shown.withColumn("_p", point), "dataset_id", "_p"), k, "cityblock",
                       block_rows=block_rows).select("src", "dst", "score", "rank")
    rich = top_overall(shown.filter("image_richness_score > 0.5"),
                       [F.desc(F.round("image_richness_score", nn.DIGITS)), F.asc("dataset_id")], k)
    offered = rich.select(F.col("dataset_id").alias("dst"), F.round("image_richness_score", nn.DIGITS).alias("score"))
    w = Window.orderBy(F.desc("score"), F.asc("dst"))  # at most k rows
    offered = offered.withColumn("rank", F.row_number().over(w))
    bare = features.filter("has_images = 0").select(F.col("dataset_id").alias("src"))
    # every item without pictures gets the same k rows: explode one bounded array instead of joining
    packed = offered.agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "score"))).alias("r")).scalar()
    given = bare.withColumn("_r", packed).select("src", F.explode("_r").alias("r")) \
        .select("src", "r.dst", "r.score", "r.rank")
    return close.unionByName(given)


def _content_text(items: DataFrame) -> DataFrame:
    return items.withColumn("text", F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("tag", F.lit(""))))


def content_neighbours(items: DataFrame, k: int, min_score: float = MIN_SCORE, size: int = ts.VOCABULARY) -> DataFrame:
    """TF-IDF cosine of description and tags."""
    points, _ = ts.tfidf(_content_text(items), "dataset_id", "text", size=size)
    return sparse_topk(points, k, min_score)


def multimodal_neighbours(items: DataFrame, vectors: DataFrame, k: int, weight: float = IMAGE_WEIGHT,
                          min_score: float = MIN_SCORE, size: int = ts.VOCABULARY) -> DataFrame:
    """(1 - w) · text cosine + w · image cosine, kept above ``min_score``.

    Both parts are unit (or zero) vectors, so the mix is the inner product of the
    concatenation scaled by the square roots of the weights. Items without any part have no neighbours.
    """
    text, _ = ts.tfidf(_content_text(items), "dataset_id", "text", size=size)
    image = vectors.select(F.col("dataset_id").alias("id"), vec.normalised("embedding").alias("i"))
    both = items.select(F.col("dataset_id").alias("id")).join(text, "id", "left").join(image, "id", "left")
    none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    t, i = F.coalesce("val", none_v), F.coalesce("i", none_v)
    mixed = both.select(
        "id",
        F.concat(F.coalesce("idx", none_i), F.transform(i, lambda x, j: j + F.lit(size))).alias("idx"),
        F.concat(F.transform(t, lambda x: x * F.lit((1 - weight) ** 0.5)),
                 F.transform(i, lambda x: x * F.lit(weight ** 0.5))).alias("val"))
    return sparse_topk(mixed.filter(F.size("idx") > 0), k, min_score, strict=True)


def neighbour_table(scored: DataFrame, k: int) -> DataFrame:
    """Top k positive scores per source, never the source itself."""
    kept = scored.filter((F.col("score") > 0) & (F.col("src") != F.col("dst"))).select("src", "dst", "score")
    return ranked(kept, k)


def vector_neighbours(vectors: DataFrame, k: int, min_score: float = MIN_SCORE,
                      block_rows: int = nn.BLOCK_ROWS) -> DataFrame:
    return nn.nearest(nn.unit_points(vectors, "dataset_id", "embedding"), k, min_score=min_score, block_rows=block_rows)


def vector_search(vectors: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Neighbours of the listed items only."""
    points = nn.unit_points(vectors, "dataset_id", "embedding")
    asks = points.join(ids.select(F.col("dataset_id").alias("id")).distinct(), "id", "left_semi")
    return nn.nearest(points, k, queries=asks)


def text_search(items: DataFrame, asked: DataFrame, key: str, text: str, k: int, size: int = ts.VOCABULARY,
                min_df: int = 2, max_df: float = 0.8, stop_words: Sequence[str] = ()) -> DataFrame:
    """Items closest to each query text in the items' own 1-2-gram TF-IDF space."""
    corpus = items.withColumn("_text", F.concat_ws(" ", "description", "tag", "dataset_name"))
    points, vocab = ts.tfidf(corpus, "dataset_id", "_text", 2, size, min_df, max_df, stop_words)
    asks = ts.weighted_rows(ts.term_counts(asked, key, text, 2, stop_words), vocab)
    return sparse_topk(points, k, 0.0, strict=True, queries=asks, exclude_self=False)


# -- popular lists ------------------------------------------------------------

def popular_pool(interactions: DataFrame, features: DataFrame, k: int, pool: int = POPULAR["pool"]) -> DataFrame:
    """The k × pool heaviest items with their quality columns."""
    weights = interactions.groupBy("dataset_id").agg(F.round(F.sum("weight"), 6).alias("total_weight"))
    best = top_overall(weights, [F.desc("total_weight"), F.asc("dataset_id")], k * pool)
    quality = features.select("dataset_id", "price", "interaction_count", "days_since_last_purchase")
    return quality.join(F.broadcast(best), "dataset_id", "right")  # the pool has k * pool rows


def _quality_rules(min_price: float, min_interaction: int, max_inactive_days: int) -> dict[str, Column]:
    return {"low_price": zero("price") < min_price,
            "low_interaction": zero("interaction_count", "long") < min_interaction,
            "inactive": F.coalesce("days_since_last_purchase", F.lit(9999)) > max_inactive_days}


def popular_items(interactions: DataFrame, features: DataFrame, k: int = 50, min_price: float = POPULAR["min_price"],
                  min_interaction: int = POPULAR["min_interaction"],
                  max_inactive_days: int = POPULAR["max_inactive_days"]) -> DataFrame:
    rules = _quality_rules(min_price, min_interaction, max_inactive_days)
    kept = popular_pool(interactions, features, k)
    for rule in rules.values():
        kept = kept.filter(~rule)
    best = top_overall(kept, [F.desc("total_weight"), F.asc("dataset_id")], k)
    w = Window.orderBy(F.desc("total_weight"), F.asc("dataset_id"))  # at most k rows
    return best.select("dataset_id", "total_weight", F.row_number().over(w).alias("rank"))


def popular_quality(interactions: DataFrame, features: DataFrame, k: int = 50, min_price: float = POPULAR["min_price"],
                    min_interaction: int = POPULAR["min_interaction"],
                    max_inactive_days: int = POPULAR["max_inactive_days"]) -> DataFrame:
    """Drops per rule, averages of what passed, and the alert flags."""
    rules = _quality_rules(min_price, min_interaction, max_inactive_days)
    passed = ~(rules["low_price"] | rules["low_interaction"] | rules["inactive"])

    def mean(c: str) -> Column:
        return zero(F.avg(F.when(passed, F.col(c))))

    row = popular_pool(interactions, features, k).agg(
        rows().alias("total_candidates"), *[F.count_if(r).alias(n) for n, r in rules.items()],
        F.count_if(passed).alias("passed_count"), mean("price").alias("avg_price"),
        mean("interaction_count").alias("avg_interaction"), mean("days_since_last_purchase").alias("avg_days_inactive"))
    share = F.when(F.col("total_candidates") > 0, 1 - F.col("passed_count") / F.col("total_candidates")).otherwise(0.0)
    high, few = share > POPULAR["alert_ratio"], F.col("passed_count") < k * 0.5
    cheap = (F.col("avg_price") > 0) & (F.col("avg_price") < 1.0)
    severity = F.when(few & (F.col("passed_count") < 5), "critical").when(high | few, "warning").when(cheap, "info")
    return row.select("*", share.alias("filter_ratio"), high.alias("high_filter_ratio"), cheap.alias("low_avg_price"),
                      few.alias("insufficient_count"), F.coalesce(severity, F.lit("none")).alias("severity"))


# -- channels -----------------------------------------------------------------

def channel(table: DataFrame, name: str, limit: int) -> DataFrame:
    """First rows of a candidate table within the channel's quota: (target, item, channel, score)."""
    quota = limit // CHANNEL_QUOTA[name]
    cut = top_per_group(table, ["target"], [F.desc("score"), F.asc("item")], quota)
    return cut.select("target", "item", F.lit(name).alias("channel"), "score")


def popular_channel(targets: DataFrame, popular: DataFrame, limit: int) -> DataFrame:
    """The same short popular list for every target, without the target itself."""
    quota = limit // CHANNEL_QUOTA["popular"]
    head = popular.filter(F.col("rank") <= quota)
    packed = head.agg(F.sort_array(F.collect_list(F.struct("rank", "dataset_id"))).alias("r")).scalar()
    given = targets.withColumn("_r", packed).select("target", F.explode("_r").alias("r"))
    return given.select("target", F.col("r.dataset_id").alias("item"), F.lit("popular").alias("channel"),
                        (0.01 - (F.col("r.rank") - 1) * 0.0001).alias("score")).filter("item <> target")


def multi_channel(tables: Mapping[str, DataFrame], limit: int) -> DataFrame:
    """Union of the channels; each input has (target, item, score)."""
    return outer_union([channel(tables[c], c, limit) for c in CHANNEL_ORDER if c in tables])


def merge_channels(candidates: DataFrame, limit: int, weights: Mapping[str, float] = MERGE_WEIGHTS) -> DataFrame:
    """Weighted sum per candidate with the channel names joined in channel order."""
    position = F.array_position(F.array(*[F.lit(c) for c in CHANNEL_ORDER]), F.col("channel"))
    weight: Column = F.lit(UNLISTED_WEIGHT)
    for name, value in weights.items():
        weight = F.when(F.col("channel") == name, F.lit(value)).otherwise(weight)
    # a candidate has at most one row per channel, so the list is as short as the channel list
    merged = candidates.groupBy("target", "item").agg(
        F.round(F.sum(F.col("score") * weight), nn.DIGITS).alias("score"),
        F.sort_array(F.collect_list(F.struct(position.alias("p"), F.col("channel").alias("c")))).alias("_c"))
    named = merged.select("target", "item", "score", F.array_join(F.transform("_c", lambda x: x["c"]), "+").alias("sources"))
    return top_per_group(named, ["target"], [F.desc("score"), F.asc("item")], limit)


def precomputed(tables: Sequence[DataFrame], limit: int) -> DataFrame:
    """Fallback list per item: every table's first rows, ordered by the best rank, then id."""
    parts = [top_per_group(t.filter("target <> item"), ["target"], [F.desc("score"), F.asc("item")], limit, "_r")
             .select("target", "item", "_r") for t in tables]
    best = outer_union(parts).groupBy("target", "item").agg(F.min("_r").alias("best_rank"))
    return top_per_group(best, ["target"], [F.asc("best_rank"), F.asc("item")], limit)


def trending(events: DataFrame, item: str, kind: str, ts_col: str, until: Column, hours: int, k: int) -> DataFrame:
    """Weighted views and clicks of the last hours."""
    start = F.timestamp_add("HOUR", F.lit(-hours), until)
    value = F.when(F.col(kind) == "view", VIEW_WEIGHT).when(F.col(kind) == "click", CLICK_WEIGHT)
    recent = events.filter((F.col(ts_col) > start) & (F.col(ts_col) <= until) & F.col(kind).isin("view", "click"))
    scored = recent.groupBy(F.col(item).alias("dataset_id")).agg(F.sum(value).alias("score"))
    return top_overall(scored, [F.desc("score"), F.asc("dataset_id")], k)


# -- content recommenders -----------------------------------------------------

def popularity_scores(ratings: DataFrame) -> DataFrame:
    """Number of ratings times the mean rating, i.e. their sum; kept in this form for the parts."""
    return ratings.groupBy("item_id").agg(rows().alias("n"), F.avg("rating").alias("mean_rating")) \
        .withColumn("score", F.round(F.col("n") * F.col("mean_rating"), nn.DIGITS))


def popular_unseen(ratings: DataFrame, k: int) -> DataFrame:
    """Most popular items a user has not rated.

    A user who rated ``m`` items finds k unseen ones among the best ``k + m``, so ranks up
    to that depth are expanded per user instead of crossing users with the catalogue.
    """
    from wayfunnel.operators.ranks import with_position
    scores = popularity_scores(ratings).select("item_id", "score")
    order = with_position(scores, "score", "item_id", "position")
    seen = ratings.select("user_id", "item_id").distinct()
    depth = seen.groupBy("user_id").agg((rows() + k).alias("depth"))
    wanted = depth.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), "depth")).alias("position"))
    offered = wanted.join(order, "position").join(seen, ["user_id", "item_id"], "left_anti")
    return top_per_group(offered, ["user_id"], [F.asc("position")], k).select("user_id", "item_id", "score", "rank")


def content_for_users(neighbours: DataFrame, interactions: DataFrame, k: int) -> DataFrame:
    """Mean similarity of an item to all items of the user (absent pairs count as 0), unseen ones only."""
    taken = interactions.select("user_id", F.col("dataset_id").alias("src")).distinct()
    sizes = taken.groupBy("user_id").agg(rows().alias("size"))
    summed = taken.join(neighbours.select("src", "dst", "score"), "src").groupBy("user_id", "dst") \
        .agg(F.sum("score").alias("s"))
    fresh = summed.join(taken.withColumnRenamed("src", "dst"), ["user_id", "dst"], "left_anti").join(sizes, "user_id")
    scored = fresh.select("user_id", F.col("dst").alias("dataset_id"),
                          F.round(F.col("s") / F.col("size"), nn.DIGITS).alias("score"))
    return top_per_group(scored, ["user_id"], [F.desc("score"), F.asc("dataset_id")], k)


def hybrid_content_neighbours(items: DataFrame, k: int, size: int = 1000) -> DataFrame:
    """Cosine of text TF-IDF joined with the scaled price and a one-hot company.

    Every company has a dimension of its own: its place among all companies in a hash order.
    """
    from wayfunnel.operators.ranks import with_position
    text, _ = ts.tfidf(_content_text(items), "dataset_id", "text", size=size)
    s = scalar(items, m=F.avg("price"), d=F.stddev_pop("price"))
    named = F.coalesce("create_company_name", F.lit("unknown"))
    companies = items.select(named.alias("company")).distinct().withColumn("_h", F.crc32(F.encode("company", "utf-8")))
    companies = with_position(companies, "_h", "company", "at").select("company", "at")
    price = F.when(s["d"] > 0, (F.col("price") - s["m"]) / s["d"]).otherwise(0.0)
    side = items.select(F.col("dataset_id").alias("id"), price.alias("p"), named.alias("company")).join(companies, "company") \
        .select("id", "p", (F.col("at") + size).cast("int").alias("h"))
    none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    joined = side.join(text, "id", "left").select(
        "id", F.concat(F.coalesce("idx", none_i), F.array(F.lit(size), F.col("h"))).alias("idx"),
        F.concat(F.coalesce("val", none_v), F.array(F.col("p"), F.lit(1.0))).alias("val"))
    unit = joined.select("id", "idx", vec.normalised("val").alias("val"))
    return sparse_topk(unit, k)


def similar_items(neighbours: DataFrame, k: int) -> DataFrame:
    return ranked(neighbours.select("src", "dst", "score"), k)


def stored_neighbours(lines: DataFrame, column: str) -> DataFrame:
    """Stored lists (JSON object: item -> [{dataset_id, score} or [id, score]]) as a long table."""
    parsed = lines.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("key", "entries")) \
        .select("key", F.posexplode("entries").alias("position", "e"))
    as_object = F.from_json("e", "dataset_id string, score string")
    as_pair = F.from_json("e", "array<string>")
    is_pair = F.col("e").startswith("[")
    dst = F.when(is_pair, F.get(as_pair, F.lit(0))).otherwise(as_object["dataset_id"]).try_cast("long")
    score = F.when(is_pair, F.get(as_pair, F.lit(1))).otherwise(as_object["score"]).try_cast("double")
    out = parsed.select(F.col("key").try_cast("long").alias("src"), "position", dst.alias("dst"),
                        zero(score).alias("score"))
    return out.filter("src is not null and dst is not null")


def share_hit(hits: Column, total: Column) -> Column:
    return ratio(hits, total)


def first_pictures(images: DataFrame, n: int) -> DataFrame:
    return pick(images, ["dataset_id"], [F.asc("image_order"), F.asc("image_key")], n)
