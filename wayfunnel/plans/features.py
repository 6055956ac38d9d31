"""Queries for interaction, user, item and image features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import AS_OF, Inputs, stored
from wayfunnel.functions.common import timestamp_lit
from wayfunnel.functions.text import stamp
from wayfunnel.operators import features as ft
from wayfunnel.operators import projections as pj
from wayfunnel.plans import tables as ptab
from wayfunnel.plans.oracle import AS_OF as SQL_AS_OF
from wayfunnel.plans.oracle import DAYS, I, R, TABLES, TAGS, TS
from wayfunnel.plans.registry import query


def now() -> "F.Column":
    return timestamp_lit(AS_OF)


@stored
def interactions(t: Inputs) -> DataFrame:
    return ft.build_interactions([
        ft.source_interactions(t.tasks, "create_user", "dataset_id", "price", "create_time", "task"),
        ft.source_interactions(t.api_orders, "creator_id", "api_id", "price", "create_time", "api_order")])


@stored
def item_stats(t: Inputs) -> DataFrame:
    return ft.item_stats(interactions(t))


def items(t: Inputs) -> DataFrame:
    return pj.item_view(t.raw_items)


def users(t: Inputs) -> DataFrame:
    return pj.user_view(t.raw_users)


@stored
def user_features(t: Inputs) -> DataFrame:
    return ft.user_features(interactions(t), users(t), items(t), now())


@stored
def item_features(t: Inputs) -> DataFrame:
    return ft.item_features(items(t), item_stats(t), now(), t.images, None, ft.vector_stats(t.vectors))


def _cols(names: str, table: str, key: str, ints: str = "", texts: str = "") -> str:
    parts = [f"{R(c)} AS {c}" for c in names.split()] + [f"{I(c)} AS {c}" for c in ints.split()]
    return f"SELECT {', '.join([key, *parts, *texts.split()])} FROM {table}"


@query("agg1_source_interactions", f"""
  SELECT buyer AS user_id, item AS dataset_id, CASE WHEN is_task THEN 'task' ELSE 'api_order' END AS source,
         {R('sum(ln(1 + greatest(coalesce(price, 0.0), 0.0)))')} AS weight, {TS('max(create_time)')} AS last_event_time
  FROM x_lines WHERE buyer IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, 3""")
def _(t: Inputs) -> DataFrame:
    parts = [ft.source_interactions(t.tasks, "create_user", "dataset_id", "price", "create_time", "task"),
             ft.source_interactions(t.api_orders, "creator_id", "api_id", "price", "create_time", "api_order")]
    return parts[0].unionByName(parts[1]).withColumn("last_event_time", stamp("last_event_time"))


@query("agg2_interactions", f"""
  SELECT user_id, dataset_id, {R('weight')} AS weight, {TS('last_event_time')} AS last_event_time FROM x_inter""")
def _(t: Inputs) -> DataFrame:
    return interactions.direct(t).withColumn("last_event_time", stamp("last_event_time"))


@query("agg3_item_stats", f"""
  SELECT dataset_id, interaction_count, {R('total_weight')} AS total_weight, {TS('last_event_time')} AS last_event_time
  FROM x_stats""")
def _(t: Inputs) -> DataFrame:
    return item_stats.direct(t).withColumn("last_event_time", stamp("last_event_time"))


TABLES["x_user_behaviour"] = f"""
  WITH b AS (SELECT user_id, count(*) AS purchase_count, sum(weight) AS total_spent, avg(weight) AS avg_purchase_amount,
                    coalesce(stddev_samp(weight), 0.0) AS purchase_amount_std, min(weight) AS min_purchase,
                    max(weight) AS max_purchase, min(last_event_time) AS first_purchase_time,
                    max(last_event_time) AS last_purchase_time FROM x_inter GROUP BY 1),
  d AS (SELECT *, {DAYS(SQL_AS_OF, 'first_purchase_time')} AS days_since_first_purchase,
               {DAYS(SQL_AS_OF, 'last_purchase_time')} AS days_since_last_purchase,
               {DAYS('last_purchase_time', 'first_purchase_time')} AS purchase_span_days FROM b)
  SELECT *, purchase_count / CAST(purchase_span_days + 1 AS DOUBLE) AS purchase_frequency,
         1.0::DOUBLE / (days_since_last_purchase + 1) AS recency_score,
         CASE WHEN days_since_last_purchase < 30 THEN 1 ELSE 0 END AS is_active_user,
         CASE WHEN purchase_count >= 10 THEN 1 ELSE 0 END AS is_power_user FROM d"""


@query("agg5_user_behaviour", f"""
  SELECT user_id, purchase_count, {R('total_spent')} AS total_spent, {R('avg_purchase_amount')} AS avg_purchase_amount,
         {R('purchase_amount_std')} AS purchase_amount_std, {R('min_purchase')} AS min_purchase,
         {R('max_purchase')} AS max_purchase, {TS('first_purchase_time')} AS first_purchase_time,
         {TS('last_purchase_time')} AS last_purchase_time FROM x_user_behaviour""")
def _(t: Inputs) -> DataFrame:
    return ft.user_behaviour(interactions(t)).withColumns({
        "first_purchase_time": stamp("first_purchase_time"), "last_purchase_time": stamp("last_purchase_time")})


@query("agg6_user_time", _cols("purchase_frequency recency_score", "x_user_behaviour", "user_id",
                               "days_since_first_purchase days_since_last_purchase purchase_span_days is_active_user is_power_user"))
def _(t: Inputs) -> DataFrame:
    return ft.user_time(ft.user_behaviour(interactions(t)), now()).select(
        "user_id", "days_since_first_purchase", "days_since_last_purchase", "purchase_span_days", "purchase_frequency",
        "recency_score", "is_active_user", "is_power_user")


TABLES["x_user_prices"] = """
  WITH p AS (SELECT user_id, min(price) AS preferred_price_min, max(price) AS preferred_price_max,
                    avg(price) AS preferred_price_mean, quantile_cont(price, 0.5) AS preferred_price_median
             FROM x_inter JOIN x_items USING (dataset_id) GROUP BY 1)
  SELECT *, CASE WHEN preferred_price_mean <= 0 THEN NULL WHEN preferred_price_mean <= 100 THEN 0.0
                 WHEN preferred_price_mean <= 500 THEN 1.0 WHEN preferred_price_mean <= 1000 THEN 2.0
                 WHEN preferred_price_mean <= 5000 THEN 3.0 ELSE 4.0 END AS preferred_price_range FROM p"""
_PRICES = "preferred_price_min preferred_price_max preferred_price_mean preferred_price_median preferred_price_range"


@query("agg7_user_prices", _cols(_PRICES, "x_user_prices", "user_id"))
def _(t: Inputs) -> DataFrame:
    return ft.user_price_preference(interactions(t), items(t))


TABLES["x_user_tags"] = f"""
  WITH e AS (SELECT dataset_id, unnest(list_filter(list_transform(string_split(tag, ';'), lambda x: trim(x)),
                                                    lambda x: x <> '')) AS tag FROM x_items),
  c AS (SELECT user_id, tag, count(*) AS n FROM x_inter JOIN e USING (dataset_id) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS r FROM c)
  SELECT user_id, count(*) AS tag_diversity,
         coalesce(max(tag) FILTER (r = 1), '') AS top_tag_1, coalesce(max(n) FILTER (r = 1), 0) AS top_tag_1_count,
         coalesce(max(tag) FILTER (r = 2), '') AS top_tag_2, coalesce(max(n) FILTER (r = 2), 0) AS top_tag_2_count,
         coalesce(max(tag) FILTER (r = 3), '') AS top_tag_3, coalesce(max(n) FILTER (r = 3), 0) AS top_tag_3_count
  FROM r GROUP BY 1"""


@query("agg8_user_tags", "SELECT * FROM x_user_tags")
def _(t: Inputs) -> DataFrame:
    return ft.user_tag_preference(interactions(t), items(t))


@query("agg9_user_diversity", f"""
  SELECT user_id, {R('count(DISTINCT dataset_id) / count(*)')} AS purchase_uniqueness_ratio
  FROM (SELECT buyer AS user_id, item AS dataset_id FROM x_lines WHERE buyer IS NOT NULL) GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    rows = t.order_lines.select(F.col("buyer").alias("user_id"), F.col("item").alias("dataset_id"))
    return ft.user_diversity(rows.filter("user_id is not null"))


TABLES["x_user_features"] = """
  SELECT u.user_id, u.company_name, u.province, u.city, u.is_consumption,
         b.* EXCLUDE (user_id), p.* EXCLUDE (user_id), g.* EXCLUDE (user_id)
  FROM x_users u LEFT JOIN x_user_behaviour b USING (user_id) LEFT JOIN x_user_prices p USING (user_id)
  LEFT JOIN x_user_tags g USING (user_id)"""
_UF = "total_spent avg_purchase_amount purchase_frequency recency_score preferred_price_mean preferred_price_range"
_UI = "is_consumption purchase_count days_since_last_purchase is_active_user is_power_user tag_diversity top_tag_1_count"


@query("agg10_user_features", f"""
  SELECT user_id, province, top_tag_1, {', '.join(f"{R(f'coalesce({c}, 0)')} AS {c}" for c in _UF.split())},
         {', '.join(f"{I(f'coalesce({c}, 0)')} AS {c}" for c in _UI.split())} FROM x_user_features""")
def _(t: Inputs) -> DataFrame:
    return user_features.direct(t).select("user_id", "province", "top_tag_1", *_UF.split(), *_UI.split())


_AUD = {k: v for k, v in ft.AUDIENCE.items()}
TABLES["x_audience"] = f"""
  SELECT i.dataset_id, {', '.join(f"avg(coalesce(u.{k}, 0)) AS {v}" for k, v in _AUD.items())},
         count(DISTINCT i.user_id) AS user_unique_buyers
  FROM x_inter i LEFT JOIN x_user_features u USING (user_id) GROUP BY 1"""


@query("agg4_item_audience", f"""
  SELECT dataset_id, {', '.join(f"{R(v)} AS {v}" for v in _AUD.values())}, user_unique_buyers FROM x_audience""")
def _(t: Inputs) -> DataFrame:
    return ft.audience_stats(interactions(t), user_features(t))


TABLES["x_item_text"] = f"""
  SELECT *, length(description) AS description_length, len({TAGS('tag')}) AS tag_count,
         len(list_filter(regexp_split_to_array(description, '\\s+'), lambda x: x <> '')) AS word_count FROM x_items"""


@query("agg11_item_text", """
  SELECT dataset_id, description_length, tag_count, word_count,
         CAST(description_length > 0 AS BIGINT) AS has_description, CAST(tag_count > 0 AS BIGINT) AS has_tags
  FROM x_item_text""")
def _(t: Inputs) -> DataFrame:
    return ft.item_text(items(t)).select("dataset_id", "description_length", "tag_count", "word_count",
                                         "has_description", "has_tags")


TABLES["x_item_pop"] = f"""
  WITH j AS (SELECT m.*, coalesce(s.interaction_count, 0) AS interaction_count, coalesce(s.total_weight, 0.0) AS total_weight,
                    s.last_event_time FROM x_item_text m LEFT JOIN x_stats s USING (dataset_id)),
  g AS (SELECT avg(price) AS pm, stddev_samp(price) AS pd, count(*) AS n FROM j)
  SELECT j.*, ln(1 + interaction_count) AS popularity_score,
         total_weight / (interaction_count + 1) AS avg_price_per_interaction,
         {DAYS(SQL_AS_OF, 'create_time')} AS days_since_created,
         {DAYS(SQL_AS_OF, 'last_event_time')} AS days_since_last_purchase,
         1.0::DOUBLE / ({DAYS(SQL_AS_OF, 'create_time')} + 1) AS age_score,
         1.0::DOUBLE / ({DAYS(SQL_AS_OF, 'last_event_time')} + 1) AS freshness_score,
         dense_rank() OVER (ORDER BY interaction_count DESC) AS popularity_rank,
         (rank() OVER (ORDER BY interaction_count) + (count(*) OVER (PARTITION BY interaction_count) - 1) / 2.0::DOUBLE) / n
           AS popularity_percentile,
         CASE WHEN price <= 0 THEN NULL WHEN price <= 100 THEN 0.0 WHEN price <= 500 THEN 1.0 WHEN price <= 1000 THEN 2.0
              WHEN price <= 5000 THEN 3.0 ELSE 4.0 END AS price_bucket,
         (price - pm) / (pd + 1) AS price_normalized
  FROM j, g"""


@query("agg12_item_popularity", _cols("popularity_score avg_price_per_interaction total_weight", "x_item_pop",
                                      "dataset_id", "interaction_count"))
def _(t: Inputs) -> DataFrame:
    return ft.item_popularity(items(t), item_stats(t)).select(
        "dataset_id", "popularity_score", "avg_price_per_interaction", "total_weight", "interaction_count")


@query("agg13_item_time", _cols("age_score freshness_score", "x_item_pop", "dataset_id",
                                "days_since_created days_since_last_purchase"))
def _(t: Inputs) -> DataFrame:
    return ft.item_time(ft.item_popularity(items(t), item_stats(t)), now()).select(
        "dataset_id", "age_score", "freshness_score", "days_since_created", "days_since_last_purchase")


@query("agg14_item_ranks", _cols("popularity_percentile", "x_item_pop", "dataset_id", "popularity_rank"))
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.ranks import with_dense_rank
    return with_dense_rank(ft.item_popularity(items(t), item_stats(t)), "interaction_count", "popularity_rank",
                           "popularity_percentile").select("dataset_id", "popularity_percentile", "popularity_rank")


@query("agg15_item_price", _cols("price_bucket price_normalized", "x_item_pop", "dataset_id"))
def _(t: Inputs) -> DataFrame:
    return ft.item_price(items(t)).select("dataset_id", "price_bucket", "price_normalized")


TABLES["x_image_features"] = f"""
  WITH s AS (SELECT dataset_id, count(id) AS image_count, avg(image_order) AS avg_image_order,
                    {DAYS(SQL_AS_OF, 'max(update_time)')} AS image_freshness_days,
                    {DAYS('max(update_time)', 'min(update_time)')} AS span FROM x_images GROUP BY 1),
  c AS (SELECT id AS cover_id, min(image_order) AS cover_position FROM x_images GROUP BY 1),
  j AS (SELECT m.dataset_id, m.cover_id, coalesce(image_count, 0) AS image_count,
               coalesce(avg_image_order, 0.0) AS avg_image_order, coalesce(image_freshness_days, 0) AS image_freshness_days,
               coalesce(image_count / CAST(span + 1 AS DOUBLE), 0.0) AS image_update_frequency,
               coalesce(1.0::DOUBLE / (image_freshness_days + 1), 0.0) AS image_freshness_score,
               coalesce(c.cover_position, 0) AS cover_position,
               CASE WHEN coalesce(image_count, 0) > 0 THEN 1 ELSE 0 END AS has_images,
               CASE WHEN m.cover_id IS NOT NULL THEN 1 ELSE 0 END AS has_cover
        FROM x_items m LEFT JOIN s USING (dataset_id) LEFT JOIN c USING (cover_id))
  SELECT *, has_images * 0.3::DOUBLE + has_cover * 0.3::DOUBLE + least(image_count / 10.0::DOUBLE, 1.0) * 0.2::DOUBLE
            + image_freshness_score * 0.2::DOUBLE AS image_richness_score FROM j"""
_IMG_D = "avg_image_order image_update_frequency image_freshness_score image_richness_score"
_IMG_I = "image_count image_freshness_days cover_position has_images has_cover"


@query("agg18_image_features", _cols(_IMG_D, "x_image_features", "dataset_id", _IMG_I))
def _(t: Inputs) -> DataFrame:
    return ft.image_features(items(t), t.images, now()).select("dataset_id", *_IMG_D.split(), *_IMG_I.split())


@query("agg19_image_counts", f"""
  SELECT dataset_id, count(id) AS image_count, {R('avg(image_order)')} AS avg_order FROM x_images GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return ft.image_counts(t.images)


TABLES["x_vec_stats"] = """
  SELECT vec_id AS dataset_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS text_embed_norm,
         list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS text_embed_mean,
         list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)) AS text_embed_std FROM embeddings"""


@query("agg21_vector_stats", _cols("text_embed_norm text_embed_mean text_embed_std", "x_vec_stats", "dataset_id"))
def _(t: Inputs) -> DataFrame:
    return ft.vector_stats(t.vectors)


@query("agg20_mean_pool", f"""
  WITH f AS (SELECT dataset_id, image_key % (SELECT count(*) FROM embeddings) AS vec_id FROM x_images
             QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY image_order, image_key) <= 4),
  d AS (SELECT dataset_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM f JOIN embeddings USING (vec_id)),
  m AS (SELECT dataset_id, dim, avg(x::DOUBLE) AS x FROM d GROUP BY 1, 2)
  SELECT dataset_id, {R('max(x) FILTER (dim = 0)')} AS embed_000, {R('max(x) FILTER (dim = 63)')} AS embed_063,
         {R('sqrt(sum(x * x))')} AS image_embed_norm FROM m GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    total = t.vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    images = t.images.withColumn("vec_id", F.pmod(F.col("image_key"), total))
    pooled = ft.mean_pool(images, t.vectors.select(F.col("dataset_id").alias("vec_id"), "embedding"))
    return pooled.select("dataset_id", F.col("image_embed_mean")[0].alias("embed_000"),
                         F.col("image_embed_mean")[63].alias("embed_063"), "image_embed_norm")


@query("agg22_pca")
def _(t: Inputs) -> DataFrame:
    """Principal components (sign and order are up to the solver, so rows only)."""
    return ft.pca(t.vectors, 10)


TABLES["x_item_features"] = """
  SELECT p.*, f.image_count, f.has_images, f.has_cover, f.avg_image_order, f.image_richness_score,
         v.text_embed_norm, v.text_embed_mean, v.text_embed_std
  FROM x_item_pop p LEFT JOIN x_image_features f USING (dataset_id) LEFT JOIN x_vec_stats v USING (dataset_id)"""
_IF = """price popularity_score popularity_percentile price_bucket price_normalized age_score freshness_score
         image_richness_score text_embed_norm"""
_II = "interaction_count popularity_rank days_since_created days_since_last_purchase image_count tag_count word_count"


def _filled(names: str, fn) -> str:
    return ", ".join(f"{fn(f'coalesce({c}, 0)')} AS {c}" for c in names.split())


@query("agg16_item_features", f"SELECT dataset_id, {_filled(_IF, R)}, {_filled(_II, I)} FROM x_item_features")
def _(t: Inputs) -> DataFrame:
    return item_features.direct(t).select("dataset_id", *_IF.split(), *_II.split())


@query("agg17_cross_features", f"""
  SELECT i.user_id, i.dataset_id, {R('1 / (1 + abs(coalesce(m.price, NULL) - coalesce(u.preferred_price_mean, 0)))')} AS price_match_score,
         CAST(coalesce(m.price >= coalesce(u.preferred_price_min, 0) AND m.price <= coalesce(u.preferred_price_max, 0), false) AS BIGINT) AS price_within_range,
         {R('coalesce(u.recency_score, 0) * coalesce(m.freshness_score, CASE WHEN m.dataset_id IS NOT NULL THEN 0 END)')} AS recency_freshness_product,
         {R('coalesce(u.is_active_user, 0) * m.popularity_score')} AS active_user_popular_item,
         {R('m.price / (coalesce(u.avg_purchase_amount, 0) + 1)')} AS price_affordability_ratio
  FROM x_inter i LEFT JOIN x_user_features u USING (user_id) LEFT JOIN x_item_features m USING (dataset_id)""")
def _(t: Inputs) -> DataFrame:
    pairs = interactions(t).select("user_id", "dataset_id")
    return ft.cross_features(pairs, user_features(t), item_features(t))


@query("agg23_item_features_with_signals", f"""
  SELECT p.dataset_id, {_filled('price popularity_score', R)},
         {', '.join(f"{R(f'coalesce(s.{c}, 0)')} AS {c}" for c in ('slot_total_exposures', 'slot_mean_ctr', 'slot_ctr_top3'))},
         {R('coalesce(a.user_active_ratio, 0)')} AS user_active_ratio,
         {I('coalesce(a.user_unique_buyers, 0)')} AS user_unique_buyers
  FROM x_item_features p LEFT JOIN x_slot_rollup s USING (dataset_id) LEFT JOIN x_audience a USING (dataset_id)""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.funnel import slot_rollup
    from wayfunnel.plans.funnel import first_events
    out = ft.item_features_with_signals(item_features(t), slot_rollup(first_events(t)["recommend_slot_metrics"]),
                                        ft.audience_stats(interactions(t), user_features(t)))
    return out.select("dataset_id", "price", "popularity_score", "slot_total_exposures", "slot_mean_ctr",
                      "slot_ctr_top3", "user_active_ratio", "user_unique_buyers")


TABLES["x_train_profile"] = f"""
  WITH p AS (SELECT user_id, count(*) AS user_interaction_count, count(DISTINCT dataset_id) AS user_unique_items,
                    avg(weight) AS user_avg_weight, sum(weight) AS user_total_weight, coalesce(avg(price), 0) AS user_avg_price,
                    coalesce(min(price), 0) AS user_min_price, coalesce(max(price), 0) AS user_max_price,
                    {DAYS('max(last_event_time)', 'min(last_event_time)')} AS user_tenure_days
             FROM x_inter LEFT JOIN x_items USING (dataset_id) GROUP BY 1),
  e AS (SELECT dataset_id, unnest({TAGS('tag')}) AS tag FROM x_items),
  g AS (SELECT user_id, tag, count(*) AS n FROM x_inter JOIN e USING (dataset_id) GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) = 1)
  SELECT p.*, coalesce(g.tag, '') AS user_top_tag FROM p LEFT JOIN g USING (user_id)"""


@query("agg24_training_profile", f"""
  SELECT user_id, user_interaction_count, user_unique_items, user_tenure_days, user_top_tag,
         {R('user_avg_weight')} AS user_avg_weight, {R('user_total_weight')} AS user_total_weight,
         {R('user_avg_price')} AS user_avg_price, {R('user_max_price - user_min_price')} AS user_price_range,
         {R('user_unique_items / user_interaction_count')} AS user_diversity FROM x_train_profile""")
def _(t: Inputs) -> DataFrame:
    return ft.training_profile(interactions(t), items(t)).select(
        "user_id", "user_interaction_count", "user_unique_items", "user_tenure_days", "user_top_tag", "user_avg_weight",
        "user_total_weight", "user_avg_price", "user_price_range", "user_diversity")


SOURCE_WEIGHTS = {"dataset_order": 1.0, "api_order": 0.8}  # parameter of the ratings query below
TABLES["x_paid"] = """
  SELECT buyer AS user_id, item AS item_id, price, 1.0::DOUBLE AS quantity, create_time,
         coalesce(pay_time, create_time) AS event_time, 'dataset_order' AS source
  FROM x_lines WHERE is_task AND is_delete = 0 AND buyer IS NOT NULL AND item IS NOT NULL AND pay_status IN (1, 5)
  UNION ALL
  SELECT buyer, item, price, coalesce(quantity, 1.0), create_time, coalesce(pay_time, create_time), 'api_order'
  FROM x_lines WHERE NOT is_task AND is_delete = 0 AND buyer IS NOT NULL AND item IS NOT NULL AND pay_status = 1"""
TABLES["x_ratings"] = f"""
  WITH r AS (SELECT *, greatest(coalesce(price, 0), 0) AS p, ln(1 + greatest(coalesce(price, 0), 0) * quantity) AS raw,
                    greatest((epoch_us({SQL_AS_OF}) - epoch_us(event_time)) / 86400000000.0::DOUBLE, 0) AS age FROM x_paid),
  s AS (SELECT *, raw * exp(-ln(2.0::DOUBLE) * age / 180) * CASE source WHEN 'api_order' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS rating FROM r)
  SELECT user_id, item_id, sum(rating) AS rating, sum(raw) AS interaction_strength, sum(p) AS total_spend,
         sum(quantity) AS total_quantity, max(event_time) AS last_event_time,
         array_to_string(list_sort(list_distinct(list(source))), ';') AS sources
  FROM s WHERE rating > 0 GROUP BY 1, 2"""


@stored
def ratings(t: Inputs) -> DataFrame:
    from wayfunnel.plans.sqlviews import paid_interactions
    return ft.decayed_ratings(paid_interactions(t), now(), 180.0, SOURCE_WEIGHTS)


@query("agg25_decayed_ratings", f"""
  SELECT user_id, item_id, {R('rating')} AS rating, {R('interaction_strength')} AS interaction_strength,
         {R('total_spend', 2)} AS total_spend, {R('total_quantity')} AS total_quantity,
         {TS('last_event_time')} AS last_event_time, sources FROM x_ratings""")
def _(t: Inputs) -> DataFrame:
    return ratings.direct(t).withColumns({"last_event_time": stamp("last_event_time"), "total_spend": F.round("total_spend", 2)})


@query("agg26_user_rollup", f"""
  SELECT user_id, count(*) AS user_interaction_count, {R('sum(rating)', 3)} AS user_total_rating,
         {R('sum(total_spend)', 3)} AS user_total_spend, {R('sum(total_quantity)', 3)} AS user_total_quantity,
         {R(f'greatest((epoch_us({SQL_AS_OF}) - epoch_us(max(last_event_time))) / 86400000000.0::DOUBLE, 0)')} AS days_since_last_event
  FROM x_ratings GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return ft.rating_rollups(ratings(t), now())[0]


@query("agg26b_item_rollup", f"""
  SELECT item_id, count(*) AS item_interaction_count, {R('sum(rating)', 3)} AS item_total_rating,
         {R('sum(total_spend)', 3)} AS item_total_revenue, {R('sum(total_quantity)', 3)} AS item_total_quantity
  FROM x_ratings GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return ft.rating_rollups(ratings(t), now())[1]


def _vectors(key: str, base: str, numbers: list[str], categories: list[str], tags: str | None, text: str, terms: int) -> str:
    first = len(numbers) + len(categories)
    scaled = "CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END"
    parts = [f"SELECT {key}, {i} AS family, '' AS label, {scaled.format(c=c)} AS value FROM b" for i, c in enumerate(numbers)]
    parts += [f"SELECT {key}, {len(numbers) + i}, {c}, 1.0 FROM b" for i, c in enumerate(categories)]
    if tags:
        parts.append(f"SELECT DISTINCT {key}, {first}, unnest(list_filter(string_split(coalesce({tags}, ''), ';'), lambda x: x <> '')), 1.0 FROM b")
    sized = " UNION ALL ".join(
        f"SELECT {key}, substr(w, CAST(unnest(generate_series(1, length(w) - {n - 1})) AS BIGINT), {n}) AS label FROM w WHERE length(w) >= {n}"
        for n in (2, 3, 4))
    return f"""
  WITH b AS ({base}),
  w AS (SELECT {key}, ' ' || w || ' ' AS w FROM (SELECT {key}, unnest(string_split({text}, ' ')) AS w FROM b) WHERE w <> ''),
  g AS (SELECT {key}, label, count(*) AS tf FROM ({sized}) GROUP BY 1, 2),
  v AS (SELECT label, ln((1 + (SELECT count(*) FROM b)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM g GROUP BY 1 ORDER BY sum(tf) DESC, label LIMIT {terms}),
  t AS (SELECT {key}, label, tf * idf AS w FROM g JOIN v USING (label)),
  c AS ({" UNION ALL ".join(parts)}
        UNION ALL SELECT {key}, {first + 1}, label, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) FROM t),
  p AS (SELECT family, label, row_number() OVER (ORDER BY family, label) - 1 AS place FROM (SELECT DISTINCT family, label FROM c))
  SELECT {key}, place, {R('value')} AS value FROM c JOIN p USING (family, label) WHERE value <> 0"""


@query("agg27_item_vectors", _vectors("item_id", f"""
    SELECT id AS item_id, coalesce(price, 0.0)::DOUBLE AS price, ln(1 + greatest(coalesce(price, 0.0), 0)) AS price_log,
           coalesce(create_company_name, 'unknown') AS company, tag, {ptab._CLEAN.format(ptab._COMBINED)} AS text FROM x_raw_items""",
    ["price", "price_log"], ["company"], "tag", "text", 5000))
def _(t: Inputs) -> DataFrame:
    """Whole item vectors in long form."""
    raw = t.raw_items.withColumnsRenamed({"id": "item_id", "dataset_name": "title"})
    ready = pj.prepare_item_text(pj.prepare_item_numbers(raw))
    return ft.vectorise(ready, "item_id", ["price", "price_log"], ["create_company_name"], "tag", "combined_text_clean", 5000)


@query("agg28_user_vectors", _vectors("user_id", f"""
    SELECT *, {ptab._CLEAN.format("'unknown ' || company || ' ' || province || ' ' || city")} AS text FROM (
      SELECT id AS user_id, coalesce(TRY_CAST(is_consumption AS DOUBLE), 0.0) AS is_consumption,
             CASE sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex, coalesce(province, 'unknown') AS province,
             coalesce(city, 'unknown') AS city, 'unknown' AS country, coalesce(company_name, 'unknown') AS company, 'unknown' AS industry
      FROM x_raw_users)""",
    ["is_consumption"], ["sex", "province", "city", "country"], "industry", "text", 3000))
def _(t: Inputs) -> DataFrame:
    """Whole user vectors in long form."""
    ready = pj.prepare_users(t.raw_users.withColumnRenamed("id", "user_id"))
    return ft.vectorise(ready, "user_id", ["is_consumption"], ["sex", "province", "city", "country"],
                        "company_industry", "profile_text_clean", 3000)


@query("agg29_user_item_cells", f"""
  SELECT user_id, item_id, {R('sum(coalesce(price, 0) * quantity)', 2)} AS value FROM x_paid GROUP BY 1, 2
  HAVING sum(coalesce(price, 0) * quantity) <> 0""")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.plans.sqlviews import paid_interactions
    paid = paid_interactions(t).withColumn("v", F.coalesce("price", F.lit(0.0)) * F.col("quantity"))
    return ft.user_item_long(paid, "v").withColumn("value", F.round("value", 2))


TABLES["x_history"] = """
  SELECT user_id, dataset_id, weight, last_event_time,
         CASE WHEN sum(weight) OVER (PARTITION BY user_id) <> 0 THEN weight / sum(weight) OVER (PARTITION BY user_id) ELSE 0 END AS share,
         row_number() OVER (PARTITION BY user_id ORDER BY last_event_time DESC, dataset_id) AS recency_rank FROM x_inter"""


@query("agg30_user_history", f"SELECT user_id, dataset_id, {R('share')} AS share, recency_rank FROM x_history")
def _(t: Inputs) -> DataFrame:
    return ft.history(interactions(t)).select("user_id", "dataset_id", "share", "recency_rank")


TABLES["x_affinity"] = f"""
  WITH e AS (SELECT dataset_id, unnest({TAGS('tag')}) AS tag FROM x_items),
  s AS (SELECT user_id, tag, sum(share) AS w FROM x_history JOIN e USING (dataset_id) GROUP BY 1, 2)
  SELECT user_id, tag, CASE WHEN sum(w) OVER (PARTITION BY user_id) <> 0 THEN w / sum(w) OVER (PARTITION BY user_id) ELSE 0 END AS affinity FROM s"""


@query("agg31_tag_affinity", f"SELECT user_id, tag, {R('affinity')} AS affinity FROM x_affinity")
def _(t: Inputs) -> DataFrame:
    return ft.tag_affinity(ft.history(interactions(t)), items(t))
