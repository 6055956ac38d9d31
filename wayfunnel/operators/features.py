"""Interaction, user, item, image and cross features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.functions import text as tx
from wayfunnel.functions import vectors as vec
from wayfunnel.functions.common import (bucket_of, days_between, fill_numeric, fractional_days, log1p_floor, scalar,
                                        split_tags, zero)
from wayfunnel.operators.ranks import with_dense_rank
from wayfunnel.operators.relational import fits_broadcast, outer_union, pick, share_of_total
from wayfunnel.session import written

# Bucket edges, activity limits and user features averaged per item.
PRICE_EDGES = (100.0, 500.0, 1000.0, 5000.0)
RANKING_PRICE_EDGES = (0.5, 1.0, 2.0, 5.0)
ACTIVE_DAYS, POWER_PURCHASES = 30, 10
TASK_LETTERS = 500_000  # whose grams a task counts, about, so that they fit its memory
SENT_LABELS = 100_000  # labels that are sent to all tasks, at most
AUDIENCE = {
    "is_consumption": "user_consumption_ratio", "is_active_user": "user_active_ratio",
    "is_power_user": "user_power_ratio", "recency_score": "user_recency_score_mean",
    "purchase_frequency": "user_purchase_frequency_mean", "preferred_price_range": "user_preferred_price_range_mean",
    "preferred_price_mean": "user_preferred_price_mean", "tag_diversity": "user_tag_diversity_mean",
    "purchase_count": "user_purchase_count_mean", "total_spent": "user_total_spent_mean",
    "avg_purchase_amount": "user_avg_purchase_amount_mean",
}


def rows() -> Column:
    return F.count(F.lit(1))


def source_interactions(df: DataFrame, user: str, item: str, price: str, time: str, source: str) -> DataFrame:
    """Weight log1p(max(price, 0)) summed and newest time per (user, item) of one order table."""
    kept = df.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    weight = log1p_floor(F.coalesce(F.col(price).try_cast("double"), F.lit(0.0)))
    return kept.groupBy(F.col(user).alias("user_id"), F.col(item).alias("dataset_id"), F.lit(source).alias("source")) \
        .agg(F.sum(weight).alias("weight"), F.max(time).alias("last_event_time"))


def build_interactions(parts: Sequence[DataFrame]) -> DataFrame:
    return outer_union(parts).groupBy("user_id", "dataset_id").agg(
        F.sum("weight").alias("weight"), F.max("last_event_time").alias("last_event_time"))


def item_stats(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("dataset_id").agg(
        rows().alias("interaction_count"), zero(F.sum("weight")).alias("total_weight"),
        F.max("last_event_time").alias("last_event_time"))


def audience_stats(interactions: DataFrame, user_features: DataFrame) -> DataFrame:
    """Mean of the buyers' features and number of distinct buyers per item."""
    names = [c for c in AUDIENCE if c in user_features.columns]
    joined = interactions.select("user_id", "dataset_id").join(user_features.select("user_id", *names), "user_id", "left")
    means = joined.groupBy("dataset_id").agg(*[zero(F.avg(c)).alias(AUDIENCE[c]) for c in names])
    # counted apart, so that pairs are told apart without the features beside them
    buyers = interactions.groupBy("dataset_id").agg(F.count_distinct("user_id").alias("user_unique_buyers"))
    return means.join(buyers.withColumnRenamed("dataset_id", "_id"), F.col("dataset_id").eqNullSafe(F.col("_id"))).drop("_id")


def user_behaviour(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(
        rows().alias("purchase_count"), F.sum("weight").alias("total_spent"),
        F.avg("weight").alias("avg_purchase_amount"), zero(F.stddev_samp("weight")).alias("purchase_amount_std"),
        F.min("weight").alias("min_purchase"), F.max("weight").alias("max_purchase"),
        F.min("last_event_time").alias("first_purchase_time"), F.max("last_event_time").alias("last_purchase_time"))


def user_time(behaviour: DataFrame, as_of: Column) -> DataFrame:
    out = behaviour.withColumns({
        "days_since_first_purchase": days_between(as_of, "first_purchase_time"),
        "days_since_last_purchase": days_between(as_of, "last_purchase_time"),
        "purchase_span_days": days_between("last_purchase_time", "first_purchase_time")})
    return out.withColumns({
        "purchase_frequency": F.col("purchase_count") / (F.col("purchase_span_days") + 1),
        "recency_score": 1.0 / F.nullif(F.col("days_since_last_purchase") + 1, F.lit(0)),
        "is_active_user": (F.col("days_since_last_purchase") < ACTIVE_DAYS).cast("int"),
        "is_power_user": (F.col("purchase_count") >= POWER_PURCHASES).cast("int")})


def user_price_preference(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Price statistics per user; the median runs on (price, count) pairs, not on rows."""
    priced = interactions.join(items.select("dataset_id", "price"), "dataset_id", "left").filter("price is not null")
    per_price = priced.groupBy("user_id", "price").agg(rows().alias("n"))
    out = per_price.groupBy("user_id").agg(
        F.min("price").alias("preferred_price_min"), F.max("price").alias("preferred_price_max"),
        (F.sum(F.col("price") * F.col("n")) / F.sum("n")).alias("preferred_price_mean"),
        F.percentile("price", 0.5, F.col("n")).alias("preferred_price_median"))
    mean = F.col("preferred_price_mean")
    # a mean of 0 or less lies outside the lowest bucket and stays empty
    return out.withColumn("preferred_price_range", F.when(mean > 0, bucket_of(mean, PRICE_EDGES, True)))


def user_tag_counts(interactions: DataFrame, items: DataFrame, lower: bool = False) -> DataFrame:
    tagged = items.select("dataset_id", F.explode(split_tags("tag", lower)).alias("tag"))
    return interactions.select("user_id", "dataset_id").join(tagged, "dataset_id") \
        .groupBy("user_id", "tag").agg(rows().alias("n"))


def user_tag_preference(interactions: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """Distinct tags and the k most frequent ones; equal counts are ordered by tag."""
    counts = user_tag_counts(interactions, items)
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), F.asc("tag"))
    best = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    cells = []
    for i in range(1, k + 1):
        here = F.col("_r") == i
        cells += [F.coalesce(F.max(F.when(here, F.col("tag"))), F.lit("")).alias(f"top_tag_{i}"),
                  zero(F.max(F.when(here, F.col("n"))), "long").alias(f"top_tag_{i}_count")]
    diversity = counts.groupBy("user_id").agg(rows().alias("tag_diversity"))
    return diversity.join(best.groupBy("user_id").agg(*cells), "user_id")


def user_diversity(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(
        (F.count_distinct("dataset_id") / rows()).alias("purchase_uniqueness_ratio"))


def user_features(interactions: DataFrame, users: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Profile, behaviour, time, price, tag and diversity features; numeric gaps are 0."""
    parts = [user_time(user_behaviour(interactions), as_of), user_price_preference(interactions, items),
             user_tag_preference(interactions, items), user_diversity(interactions)]
    out = users
    for part in parts:
        out = out.join(part, "user_id", "left")
    return fill_numeric(out)


def item_text(items: DataFrame) -> DataFrame:
    out = items.withColumns({
        "description_length": F.length(F.coalesce("description", F.lit(""))).cast("long"),
        "tag_count": F.size(split_tags("tag")).cast("long"), "word_count": tx.word_count("description")})
    return out.withColumns({"has_description": (F.col("description_length") > 0).cast("int"),
                            "has_tags": (F.col("tag_count") > 0).cast("int")})


def item_popularity(items: DataFrame, stats: DataFrame) -> DataFrame:
    out = items.join(stats, "dataset_id", "left").withColumns({
        "interaction_count": zero("interaction_count", "long"), "total_weight": zero("total_weight")})
    per = F.col("total_weight") / (F.col("interaction_count") + 1)
    return out.withColumns({
        "popularity_score": F.log1p(F.col("interaction_count").cast("double")), "avg_price_per_interaction": per,
        "estimated_revenue": F.col("total_weight"), "revenue_per_interaction": per})


def item_time(items: DataFrame, as_of: Column) -> DataFrame:
    def inverse(days: str) -> Column:
        return 1.0 / F.nullif(F.col(days) + 1, F.lit(0))

    out = items.withColumns({"days_since_created": days_between(as_of, "create_time"),
                             "days_since_last_purchase": days_between(as_of, "last_event_time")})
    return out.withColumns({"age_score": inverse("days_since_created"),
                            "freshness_score": inverse("days_since_last_purchase")})


def item_price(items: DataFrame) -> DataFrame:
    """Right-closed price bucket (0 and less stay empty) and price against mean and deviation."""
    s = scalar(items, m=F.avg("price"), d=F.stddev_samp("price"))
    return items.withColumns({
        "price_bucket": F.when(F.col("price") > 0, bucket_of("price", PRICE_EDGES, True)),
        "price_normalized": (F.col("price") - s["m"]) / (s["d"] + 1)})


def image_features(items: DataFrame, images: DataFrame, as_of: Column) -> DataFrame:
    """Counts, order, update rhythm, cover slot and richness of an item's pictures."""
    stats = images.groupBy("dataset_id").agg(
        F.count("id").alias("image_count"), F.avg("image_order").alias("avg_image_order"),
        F.min("image_order").alias("min_image_order"), F.max("image_order").alias("max_image_order"),
        F.max("update_time").alias("_latest"), F.min("update_time").alias("_first"))
    stats = stats.withColumns({"image_freshness_days": days_between(as_of, "_latest"),
                               "image_update_span_days": days_between("_latest", "_first")})
    stats = stats.withColumns({
        "image_update_frequency": F.col("image_count") / (F.col("image_update_span_days") + 1),
        "image_freshness_score": 1.0 / F.nullif(F.col("image_freshness_days") + 1, F.lit(0))}).drop("_latest", "_first")
    # one slot per picture id, so the cover join cannot repeat items
    cover = images.groupBy(F.col("id").alias("cover_id")).agg(F.min("image_order").alias("cover_position"))
    out = items.select("dataset_id", F.col("cover_id").try_cast("long").alias("cover_id")) \
        .join(stats, "dataset_id", "left").join(cover, "cover_id", "left")
    out = out.withColumns({"has_images": (zero("image_count") > 0).cast("int"),
                           "has_cover": F.col("cover_id").isNotNull().cast("int")})
    richness = (F.col("has_images") * 0.3 + F.col("has_cover") * 0.3
                + F.least(zero("image_count") / 10, F.lit(1.0)) * 0.2 + zero("image_freshness_score") * 0.2)
    return fill_numeric(out.withColumn("image_richness_score", richness), skip=("cover_id",))


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("dataset_id").agg(F.count("id").alias("image_count"), F.avg("image_order").alias("avg_order"))


def mean_pool(images: DataFrame, vectors: DataFrame, per_item: int = 4) -> DataFrame:
    """Mean vector of the first pictures of each item and its length.

    ``images`` carries (dataset_id, image_order, image_key, vec_id). Vectors stay
    whole: they are taken apart only where those of an item meet.
    """
    first = pick(images, ["dataset_id"], [F.asc("image_order"), F.asc("image_key")], per_item)
    # at most ``per_item`` vectors are gathered for an item
    gathered = first.join(vectors, "vec_id").groupBy("dataset_id").agg(F.collect_list("embedding").alias("vectors"))
    width = F.array_max(F.transform("vectors", F.size))

    def mean(place: Column) -> Column:
        cells = F.array_compact(F.transform("vectors", lambda v: F.get(v, place).cast("double")))
        return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda total, x: total + x) / F.size(cells))

    pooled = gathered.filter(width > 0).select("dataset_id", F.transform(F.sequence(F.lit(0), width - 1), mean).alias("image_embed_mean"))
    return pooled.withColumn("image_embed_norm", vec.norm("image_embed_mean"))


def vector_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.select("dataset_id", vec.norm(column).alias("text_embed_norm"),
                          vec.mean(column).alias("text_embed_mean"), vec.population_std(column).alias("text_embed_std"))


def pca(vectors: DataFrame, k: int, column: str = "embedding") -> DataFrame:
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("dataset_id", array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(data).transform(data)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    out = model.transform(centred).select("dataset_id", vector_to_array("p").alias("p"))
    return out.select("dataset_id", *[F.col("p")[i].alias(f"text_pca_{i}") for i in range(k)])


IMAGE_COLUMNS = ("image_count", "has_images", "has_cover", "avg_image_order", "image_freshness_days",
                 "image_freshness_score", "image_update_frequency", "image_richness_score", "cover_position")


def item_features(items: DataFrame, stats: DataFrame, as_of: Column, images: DataFrame | None = None,
                  image_vectors: DataFrame | None = None, text_vectors: DataFrame | None = None) -> DataFrame:
    out = items
    if images is not None:
        out = out.join(image_features(items, images, as_of).select("dataset_id", *IMAGE_COLUMNS), "dataset_id", "left")
    for side in (image_vectors, text_vectors):
        if side is not None:
            out = out.join(side, "dataset_id", "left")
    out = item_time(item_popularity(item_text(out), stats), as_of)
    out = with_dense_rank(out, "interaction_count", "popularity_rank", "popularity_percentile")
    return fill_numeric(item_price(out), skip=("cover_id",))


def item_features_with_signals(features: DataFrame, slots: DataFrame, audience: DataFrame) -> DataFrame:
    """Item features joined with rolled-up slot metrics and audience statistics; gaps are 0."""
    return fill_numeric(features.join(slots, "dataset_id", "left").join(audience, "dataset_id", "left"),
                        skip=("cover_id",))


def cross_features(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Match of user and item for given (user, item) pairs."""
    u = users.select("user_id", "preferred_price_min", "preferred_price_max", "preferred_price_mean", "recency_score",
                     "is_active_user", "avg_purchase_amount")
    i = items.select("dataset_id", "price", "freshness_score", "popularity_score")
    joined = pairs.join(u, "user_id", "left").join(i, "dataset_id", "left")
    price = F.col("price")
    inside = (price >= F.col("preferred_price_min")) & (price <= F.col("preferred_price_max"))
    return joined.select(
        "user_id", "dataset_id",
        (1 / (1 + F.abs(price - F.col("preferred_price_mean")))).alias("price_match_score"),
        F.coalesce(inside, F.lit(False)).cast("int").alias("price_within_range"),
        (F.col("recency_score") * F.col("freshness_score")).alias("recency_freshness_product"),
        (F.col("is_active_user") * F.col("popularity_score")).alias("active_user_popular_item"),
        (price / (F.col("avg_purchase_amount") + 1)).alias("price_affordability_ratio"))


def training_profile(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """User profile for training: counts, weights, prices, tenure, diversity, top tag."""
    joined = interactions.join(items.select("dataset_id", "price"), "dataset_id", "left")
    per = joined.groupBy("user_id").agg(
        rows().alias("user_interaction_count"), F.count_distinct("dataset_id").alias("user_unique_items"),
        F.avg("weight").alias("user_avg_weight"), F.sum("weight").alias("user_total_weight"),
        zero(F.avg("price")).alias("user_avg_price"), zero(F.min("price")).alias("user_min_price"),
        zero(F.max("price")).alias("user_max_price"),
        zero(days_between(F.max("last_event_time"), F.min("last_event_time")), "long").alias("user_tenure_days"))
    counts = user_tag_counts(interactions, items, lower=True)
    best = pick(counts, ["user_id"], [F.desc("n"), F.asc("tag")]).select("user_id", F.col("tag").alias("user_top_tag"))
    return per.join(best, "user_id", "left").withColumns({
        "user_diversity": F.col("user_unique_items") / F.col("user_interaction_count"),
        "user_price_range": F.col("user_max_price") - F.col("user_min_price"),
        "user_top_tag": F.coalesce("user_top_tag", F.lit(""))})


def decayed_ratings(orders: DataFrame, as_of: Column, half_life_days: float = 180.0,
                    source_weights: Mapping[str, float] | None = None) -> DataFrame:
    """Ratings log1p(price * quantity) * 2^(-age / half life) * source weight, positive ones only,
    summed per (user, item) with the sorted distinct sources."""
    price = F.greatest(F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    quantity = F.coalesce(F.col("quantity").try_cast("double"), F.lit(1.0))
    quantity = F.when(quantity <= 0, 1.0).otherwise(quantity)
    when = F.coalesce("event_time", "create_time", as_of)
    age = F.greatest(fractional_days(as_of, when), F.lit(0.0))
    decay = F.exp(-F.lit(0.6931471805599453) * age / half_life_days) if half_life_days > 0 else F.lit(1.0)
    weight: Column = F.lit(1.0)
    for name, value in (source_weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    valued = orders.withColumns({"_price": price, "_quantity": quantity, "_when": when,
                                 "_raw": F.log1p(price * quantity), "source": F.coalesce("source", F.lit("unknown"))})
    rated = valued.withColumn("_rating", F.col("_raw") * decay * weight).filter("_rating > 0")
    return rated.groupBy("user_id", "item_id").agg(
        F.sum("_rating").alias("rating"), F.sum("_raw").alias("interaction_strength"),
        F.sum("_price").alias("total_spend"), F.sum("_quantity").alias("total_quantity"),
        F.max("_when").alias("last_event_time"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))), ";").alias("sources"))


def rating_rollups(ratings: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    def per(key: str, prefix: str, spend: str, newest: bool) -> DataFrame:
        extra = [F.greatest(fractional_days(as_of, F.max("last_event_time")), F.lit(0.0))
                 .alias("days_since_last_event")] if newest else []
        return ratings.groupBy(key).agg(
            rows().alias(f"{prefix}_interaction_count"), F.round(F.sum("rating"), 3).alias(f"{prefix}_total_rating"),
            F.round(F.sum("total_spend"), 3).alias(f"{prefix}_total_{spend}"),
            F.round(F.sum("total_quantity"), 3).alias(f"{prefix}_total_quantity"), *extra)

    return per("user_id", "user", "spend", True), per("item_id", "item", "revenue", False)


def user_item_long(ratings: DataFrame, value: str) -> DataFrame:
    """User by item matrix kept sparse: one row per non-empty cell."""
    return ratings.groupBy("user_id", "item_id").agg(F.sum(value).alias("value")).filter("value <> 0")


def user_item_wide(cells: DataFrame, items: Sequence[int]) -> DataFrame:
    """Pivot of a named, short list of items for export."""
    return cells.groupBy("user_id").pivot("item_id", list(items)).agg(F.sum("value")).na.fill(0.0)


def history(interactions: DataFrame, limit: int | None = None) -> DataFrame:
    """Normalised user history, newest first."""
    shared = share_of_total(interactions, ["user_id"], "weight", "share")
    w = Window.partitionBy("user_id").orderBy(F.desc("last_event_time"), F.asc("dataset_id"))
    out = shared.withColumn("recency_rank", F.row_number().over(w))
    return out.filter(F.col("recency_rank") <= limit) if limit else out


def tag_affinity(shared: DataFrame, items: DataFrame) -> DataFrame:
    """Tag weights per user, summing to 1."""
    tagged = items.select("dataset_id", F.explode(split_tags("tag")).alias("tag"))
    sums = shared.select("user_id", "dataset_id", "share").join(tagged, "dataset_id") \
        .groupBy("user_id", "tag").agg(F.sum("share").alias("weight"))
    return share_of_total(sums, ["user_id"], "weight", "affinity").select("user_id", "tag", "affinity")


def _scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("d")).alias(c) for c in columns]
    stats = df.agg(F.struct(*parts).alias("s")).scalar()
    return df.withColumns({f"{c}_scaled": F.when(stats[c]["d"] > 0, (F.col(c) - stats[c]["m"]) / stats[c]["d"])
                           .otherwise(0.0) for c in columns})


def numbered(labels: DataFrame) -> DataFrame:
    """Place of each distinct (family, label) in the order of both, counted from 0.

    Labels lie in ranges of that order; a range is numbered in one task and moved by the sizes of those before it, so
    neither the driver nor a task holds all labels.
    """
    distinct = labels.select("family", "label").distinct()
    ranges = written(distinct.repartitionByRange("family", "label").withColumn("_range", F.spark_partition_id()), "labels")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # a row for each range
    sizes = ranges.groupBy("_range").agg(rows().alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("family", "label")) - 1
    return ranges.withColumn("_own", own).join(sizes, "_range").select(
        "family", "label", (F.col("_before") + F.col("_own")).alias("place"))


def char_grams(text: Column, least: int = 2, most: int = 4) -> Column:
    """Character grams inside blank-padded words; a gram is never longer than its word."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        long_enough = F.filter(words, lambda w: F.length(w) >= n)
        return F.flatten(F.transform(long_enough, lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))))

    return F.concat(*[of(n) for n in range(least, most + 1)])


def vectorise(df: DataFrame, key: str, numbers: Sequence[str], categories: Sequence[str], tags: str | None,
              text: str, terms: int) -> DataFrame:
    """Sparse feature vectors in long form, (key, place, value) without zeros: scaled numbers, one-hot categories and tags,
    TF-IDF of character 2-4-grams by rows of length 1 over the ``terms`` most frequent grams.

    Families stand in that order, labels of a family in the order of their text.
    """
    scaled = _scaled(df.withColumns({c: zero(c) for c in numbers}), numbers)
    flags = [F.struct(F.lit(i).alias("family"), F.lit("").alias("label"), F.col(f"{c}_scaled").alias("value")) for i, c in enumerate(numbers)]
    flags += [F.struct(F.lit(len(numbers) + i).alias("family"), F.col(c).cast("string").alias("label"), F.lit(1.0).alias("value"))
              for i, c in enumerate(categories)]
    marked = F.array(*flags)
    first = len(numbers) + len(categories)
    if tags:
        own = F.array_distinct(F.filter(F.split(F.coalesce(F.col(tags), F.lit("")), ";"), lambda x: x != ""))
        marked = F.concat(marked, F.transform(own, lambda x: F.struct(F.lit(first).alias("family"), x.alias("label"), F.lit(1.0).alias("value"))))
    short = scaled.select(key, F.inline(marked)).filter("label is not null")
    texts = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    letters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(letters / TASK_LETTERS))
    # texts travel whole to the task of their key, where their grams are counted
    counts = written(texts.repartition(tasks, key).select(key, F.explode(char_grams(F.col("text"))).alias("label"))
                     .groupBy(key, "label").agg(rows().alias("tf")), "grams")
    total = df.agg(rows()).scalar()
    vocabulary = counts.groupBy("label").agg(rows().alias("df"), F.sum("tf").alias("n")) \
        .orderBy(F.desc("n"), F.asc("label")).limit(terms) \
        .select("label", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(F.broadcast(vocabulary), "label").select(key, "label", (F.col("tf") * F.col("idf")).alias("w"))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    grams = weighed.join(length, key).select(key, F.lit(first + 1).alias("family"), "label", (F.col("w") / F.col("length")).alias("value"))
    cells = written(short.unionByName(grams), "feature-cells")
    places = numbered(cells)
    # cells are small on disk and many in memory, so it is never they that are broadcast
    known = F.broadcast(places) if fits_broadcast(places, SENT_LABELS) else places.hint("shuffle_merge")
    return cells.join(known, ["family", "label"]).filter("value <> 0").select(key, "place", "value")
