"""Queries for fusion, personalisation, re-ranking and experiments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import Inputs, every, stored
from wayfunnel.functions import text as tx
from wayfunnel.functions.common import days_between, timestamp_lit
from wayfunnel.operators import experiments as ex
from wayfunnel.operators import features as ft
from wayfunnel.operators import funnel as fn
from wayfunnel.operators import ranking as rk
from wayfunnel.operators import recall as rc
from wayfunnel.plans import features as pf
from wayfunnel.plans import funnel as pfun
from wayfunnel.plans import recall as pr
from wayfunnel.plans.oracle import AS_OF as SQL_AS_OF
from wayfunnel.plans.oracle import DAYS, I, R, TABLES
from wayfunnel.plans.oracle import TAGS as SQL_TAGS
from wayfunnel.plans.registry import query
from wayfunnel.plans.sqlviews import live_items

LIMIT = 10
VARIANTS = (("control", 0.5), ("test", 0.3), ("bold", 0.2))


@stored
def requests(t: Inputs) -> DataFrame:
    """One request per user for the newest item in the history."""
    newest = ft.history(pf.interactions(t), 1)
    live = pf.items(t).select("dataset_id")
    return newest.join(live, "dataset_id", "left_semi").select(
        F.col("user_id").alias("request_id"), "user_id", F.col("dataset_id").alias("target"),
        F.when(every("user_id", 2), "recommend_detail").otherwise("recommend_similar").alias("endpoint"),
        F.when(every("user_id", 4), "search").when(every("user_id", 4, 1), "landing").alias("source"),
        F.when(every("user_id", 3), "mobile").otherwise("desktop").alias("device_type"))


TABLES["x_requests"] = """
  SELECT user_id AS request_id, user_id, dataset_id AS target,
         CASE WHEN user_id % 2 = 0 THEN 'recommend_detail' ELSE 'recommend_similar' END AS endpoint,
         CASE user_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'landing' END AS source,
         CASE WHEN user_id % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type
  FROM x_history WHERE recency_rank = 1 AND dataset_id IN (SELECT dataset_id FROM x_items)"""


_KNOWN = tuple(ex.DEFAULT_WEIGHTS)
_TOK = "list_filter(string_split(lower(trim(coalesce(reason, ''))), '+'), lambda x: x <> '')"
TABLES["x_channel_weights"] = f"""
  WITH k AS (SELECT *, {_TOK} AS tokens FROM x_exposures),
  h AS (SELECT *, list_filter(tokens, lambda x: x IN {_KNOWN} OR starts_with(x, 'fallback'))[1] AS hit FROM k WHERE len(tokens) > 0),
  e AS (SELECT request_id, dataset_id, CASE WHEN hit IS NULL THEN tokens[1] WHEN hit IN {_KNOWN} THEN hit ELSE 'fallback' END AS channel FROM h),
  g AS (SELECT channel, count(*) AS n,
               count(*) FILTER (EXISTS (SELECT 1 FROM x_clicks c WHERE c.request_id = e.request_id AND c.dataset_id = e.dataset_id)) AS c,
               count(*) FILTER (EXISTS (SELECT 1 FROM x_conversions c WHERE c.request_id = e.request_id AND c.dataset_id = e.dataset_id)) AS v
        FROM e GROUP BY 1),
  r AS (SELECT channel, CASE WHEN n < 300 THEN coalesce(w.weight, 0.1)
                             ELSE 0.8::DOUBLE * (c + 2) / (n + 50) + 0.2::DOUBLE * (v + 2) / (n + 50) END AS raw
        FROM g LEFT JOIN x_default_weights w USING (channel))
  SELECT coalesce(r.channel, w.channel) AS channel,
         coalesce(round(raw * (SELECT sum(weight) FROM x_default_weights) / sum(raw) OVER (), 6), round(w.weight, 6)) AS weight
  FROM r FULL JOIN x_default_weights w ON r.channel = w.channel"""


def _norm(table: str, name: str, part: str = "target") -> str:
    return (f"CASE WHEN max({name}) OVER (PARTITION BY {part}) > min({name}) OVER (PARTITION BY {part}) THEN "
            f"({name} - min({name}) OVER (PARTITION BY {part})) / (max({name}) OVER (PARTITION BY {part}) - "
            f"min({name}) OVER (PARTITION BY {part})) ELSE 0.0 END")


@query("rnk1_normalised_channels", f"""
  SELECT target, channel, item, {R(_norm('x_channels', 'score', 'target, channel'))} AS norm FROM x_channels""")
def _(t: Inputs) -> DataFrame:
    return rk.min_max(pr.channels(t), ["target", "channel"], "score").select("target", "channel", "item", "norm")


TABLES["x_gated"] = """
  SELECT p.dataset_id, p.rank, 1.0::DOUBLE - (p.rank - 1) / CAST((SELECT count(*) FROM x_popular) AS DOUBLE) * 0.9::DOUBLE AS score
  FROM x_popular p LEFT JOIN x_item_features m USING (dataset_id)
  WHERE NOT coalesce((m.price < 1.90 AND m.interaction_count < 66)
                     OR (m.days_since_last_purchase > 180 AND m.interaction_count < 30), false)"""


def gated(t: Inputs) -> DataFrame:
    return rk.popular_gate(pr.popular(t), pf.item_features(t))


@query("rnk3_popular_gate", f"SELECT dataset_id, rank, {R('score')} AS score FROM x_gated")
def _(t: Inputs) -> DataFrame:
    return gated(t)


TABLES["x_fused"] = f"""
  WITH n AS (
    SELECT src AS target, dst AS item, 1.2::DOUBLE * ({_norm('', 'score', 'src')}) AS s, 0 AS p, 'behavior' AS c FROM x_behaviour
    UNION ALL SELECT src, dst, 1.0::DOUBLE * ({_norm('', 'score', 'src')}), 1, 'content' FROM x_content
    UNION ALL SELECT src, dst, 0.8::DOUBLE * ({_norm('', 'score', 'src')}), 2, 'vector' FROM x_vector_sim),
  g AS (SELECT target, item, round(sum(s), 9) AS score, string_agg(c, '+' ORDER BY p) AS reason FROM n GROUP BY 1, 2)
  SELECT * FROM g
  UNION ALL
  SELECT m.dataset_id, p.dataset_id, round(p.score * 0.02::DOUBLE, 9), 'popular' FROM x_items m JOIN x_gated p ON m.dataset_id <> p.dataset_id
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.target = m.dataset_id AND g.item = p.dataset_id)
  QUALIFY row_number() OVER (PARTITION BY m.dataset_id ORDER BY p.rank) <= 50"""


@stored
def fused(t: Inputs) -> DataFrame:
    return rk.fuse({"behavior": pr._as_channel(pr.behaviour(t)), "content": pr._as_channel(pr.content(t)),
                    "vector": pr._as_channel(pr.vector_table(t))},
                   gated(t), pf.items(t).select(F.col("dataset_id").alias("target")), LIMIT)


@query("rnk2_fused_scores", f"SELECT target, item, {R('score')} AS score, reason FROM x_fused")
def _(t: Inputs) -> DataFrame:
    return fused.direct(t)


TABLES["x_candidates"] = """
  SELECT r.request_id, r.user_id, f.item, f.score, f.reason FROM x_requests r JOIN x_fused f USING (target)"""
TABLES["x_tag_overlap"] = f"""
  WITH p AS (SELECT a.dataset_id AS target, b.dataset_id AS item, CAST(count(*) * count(*) AS DOUBLE) AS s
             FROM x_item_tags a JOIN x_item_tags b ON a.tag = b.tag AND a.dataset_id <> b.dataset_id GROUP BY 1, 2),
  n AS (SELECT target, item, {_norm('', 's')} AS norm FROM p)
  SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY target ORDER BY norm DESC, item) <= 20"""


def _augmented(base: str) -> str:
    return f"""
  SELECT request_id, user_id, item, round(sum(score), 9) AS score, string_agg(c, '+' ORDER BY p) AS reason FROM (
    SELECT request_id, user_id, item, score, -1 AS p, reason AS c FROM {base}
    UNION ALL SELECT request_id, user_id, item, norm * 0.4::DOUBLE, 0, 'tag' FROM x_requests JOIN x_tag_overlap USING (target) WHERE norm > 0
    UNION ALL SELECT request_id, user_id, dst, 0.3::DOUBLE, 1, 'category' FROM x_requests JOIN x_category_sim ON target = src
    UNION ALL SELECT request_id, user_id, dst, 0.25::DOUBLE, 2, 'price' FROM x_requests JOIN x_price_sim ON target = src
    UNION ALL SELECT request_id, user_id, dataset_id, score * 0.6::DOUBLE, 3, 'usercf' FROM x_requests JOIN x_user_cand USING (user_id)
      WHERE dataset_id <> target) GROUP BY 1, 2, 3"""


def extra_channels(t: Inputs) -> list[rk.Extra]:
    asks, items = requests(t).select("request_id", "user_id", "target"), pf.items(t)

    def per_target(table: DataFrame) -> DataFrame:
        return asks.join(table, "target").select("request_id", "user_id", "item", "score")

    users = rc.user_candidates(pr.user_sim(t), pf.interactions(t), pr.K)
    own = asks.join(users, "user_id").filter("dataset_id <> target") \
        .select("request_id", "user_id", F.col("dataset_id").alias("item"), "score")
    tags = rk.tag_overlap(items, 2 * LIMIT).withColumnRenamed("norm", "score")
    return [rk.Extra("tag", per_target(tags), rk.TAG_BOOST),
            rk.Extra("category", per_target(pr._as_channel(rc.category_neighbours(items, 2 * LIMIT))), rk.CATEGORY_BOOST),
            rk.Extra("price", per_target(pr._as_channel(rc.price_neighbours(items, 2 * LIMIT))), rk.PRICE_BOOST),
            rk.Extra("usercf", own, rk.USER_BOOST)]


@query("rnk4_augmented_channels", f"""
  SELECT request_id, item, {R('score')} AS score, reason FROM ({_augmented('x_candidates')})""")
def _(t: Inputs) -> DataFrame:
    base = requests(t).select("request_id", "user_id", "target").join(fused(t), "target") \
        .select("request_id", "user_id", "item", "score", "reason")
    return rk.augment(base, extra_channels(t)).select("request_id", "item", "score", "reason")


def signals(t: Inputs) -> DataFrame:
    def per(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy(F.col("src").alias("target")).agg(F.count(F.lit(1)).alias(name))

    asks = requests(t).select("request_id", "target", "user_id")
    tags = rc.tag_index(pf.items(t)).select(F.col("dataset_id").alias("target")).distinct().withColumn("has_tags", F.lit(True))
    out = asks.join(per(pr.behaviour(t), "behaviour_n"), "target", "left") \
        .join(per(pr.content(t), "content_n"), "target", "left") \
        .join(per(pr.vector_table(t), "vector_n"), "target", "left").join(tags, "target", "left")
    return out.na.fill(0, ["behaviour_n", "content_n", "vector_n"]).na.fill(False, ["has_tags"]) \
        .withColumn("has_history", ~every("user_id", 5))


def _moved(base: str) -> str:
    """Weights moved by the signals of each request; ``base``: request_id, wb, wc, wv, wp."""
    return f"""
  WITH s AS (SELECT request_id, r.user_id, target, r.user_id % 5 <> 0 AS h, coalesce(b.n, 0) AS b, coalesce(c.n, 0) AS c, coalesce(v.n, 0) AS v,
                    target IN (SELECT dataset_id FROM x_item_tags) AS g, wb, wc, wv, wp
             FROM x_requests r JOIN ({base}) USING (request_id) LEFT JOIN (SELECT src, count(*) AS n FROM x_behaviour GROUP BY 1) b ON b.src = target
             LEFT JOIN (SELECT src, count(*) AS n FROM x_content GROUP BY 1) c ON c.src = target
             LEFT JOIN (SELECT src, count(*) AS n FROM x_vector_sim GROUP BY 1) v ON v.src = target),
  s1 AS (SELECT * REPLACE (CASE WHEN h THEN wb ELSE wb * 0.5 END AS wb, CASE WHEN h THEN wc ELSE wc + wb * 0.5 / 3 END AS wc,
                           CASE WHEN h THEN wv ELSE wv + wb * 0.5 / 3 END AS wv, CASE WHEN h THEN wp ELSE wp + wb * 0.5 / 3 END AS wp) FROM s),
  s2 AS (SELECT * REPLACE (wb - CASE WHEN b < 3 THEN wb * 0.3 ELSE 0 END AS wb, wc + CASE WHEN b < 3 THEN wb * 0.15 ELSE 0 END AS wc,
                           wv + CASE WHEN b < 3 THEN wb * 0.15 ELSE 0 END AS wv) FROM s1),
  s3 AS (SELECT * REPLACE (wc - CASE WHEN c < 3 THEN wc * 0.3 ELSE 0 END AS wc, wb + CASE WHEN c < 3 THEN wc * 0.15 ELSE 0 END AS wb,
                           wv + CASE WHEN c < 3 THEN wc * 0.15 ELSE 0 END AS wv) FROM s2),
  s4 AS (SELECT * REPLACE (CASE WHEN v = 0 THEN wv * 0.5 WHEN v < 5 THEN wv + 0.1 ELSE wv END AS wv,
                           wb + CASE WHEN v = 0 THEN wv * 0.25 ELSE 0 END AS wb, wc + CASE WHEN v = 0 THEN wv * 0.25 ELSE 0 END AS wc) FROM s3)
  SELECT * REPLACE (wc - CASE WHEN NOT g THEN wc * 0.2 ELSE 0 END AS wc, wb + CASE WHEN NOT g THEN wc * 0.1 ELSE 0 END AS wb,
                    wv + CASE WHEN NOT g THEN wc * 0.1 ELSE 0 END AS wv) FROM s4"""


_FIXED = "SELECT request_id, 1.2::DOUBLE AS wb, 1.0::DOUBLE AS wc, 0.8::DOUBLE AS wv, 0.02::DOUBLE AS wp FROM x_requests"


@query("rnk5_dynamic_weights", f"""
  SELECT request_id, {R('wb')} AS w_behavior, {R('wc')} AS w_content, {R('wv')} AS w_vector, {R('wp')} AS w_popular
  FROM ({_moved(_FIXED)})""")
def _(t: Inputs) -> DataFrame:
    return rk.dynamic_weights(signals(t)).select("request_id", "w_behavior", "w_content", "w_vector", "w_popular")


@query("rnk6_overridden_weights", f"""
  SELECT v.variant, c.channel, {R("CASE WHEN v.variant = 'test' AND c.channel = 'content' THEN 1.5 ELSE coalesce(w.weight, c.weight) END")} AS weight
  FROM (SELECT DISTINCT coalesce(experiment_variant, 'control') AS variant FROM x_exposures) v
  CROSS JOIN (SELECT * FROM (VALUES ('behavior', 1.2::DOUBLE), ('content', 1.0), ('vector', 0.8), ('popular', 0.02)) x(channel, weight)) c
  LEFT JOIN x_channel_weights w USING (channel)""")
def _(t: Inputs) -> DataFrame:
    variants = t.exposures.select(F.coalesce("experiment_variant", F.lit("control")).alias("variant")).distinct()
    base = variants.select("variant", F.explode(F.create_map(*[
        x for k, v in rk.CHANNEL_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])).alias("channel", "weight"))
    params = variants.filter("variant = 'test'").select("variant", F.lit("content").alias("channel"), F.lit(1.5).alias("weight"))
    return rk.overridden_weights(base, trained_weights(t), params)


_DECAY = f"pow(0.5::DOUBLE, (epoch_us({SQL_AS_OF}) - epoch_us(last_event_time)) / 86400000000.0::DOUBLE / 7)"


def _personal(base: str) -> str:
    return f"""
  WITH h AS (SELECT *, {_DECAY} AS decay FROM x_history WHERE recency_rank <= 50),
  f AS (SELECT c.* FROM {base} c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = c.user_id AND h.dataset_id = c.item)),
  b1 AS (SELECT h.user_id, b.dst AS item, sum(b.score * share * decay) * 0.5 AS b1 FROM h JOIN x_behaviour b ON b.src = h.dataset_id GROUP BY 1, 2),
  d AS (SELECT user_id, avg(decay) AS mean_decay FROM h WHERE recency_rank <= 5 GROUP BY 1),
  b2 AS (SELECT f.user_id, f.item, sum(a.affinity) * any_value(mean_decay) * 0.2 AS b2
         FROM f JOIN x_item_tags g ON g.dataset_id = f.item JOIN x_affinity a ON a.user_id = f.user_id AND a.tag = g.tag
         JOIN d ON d.user_id = f.user_id GROUP BY 1, 2)
  SELECT f.request_id, f.user_id, f.item, round(f.score + coalesce(b1, 0) + coalesce(b2, 0), 9) AS score,
         CASE WHEN coalesce(b1, 0) + coalesce(b2, 0) > 0 THEN reason || '+personalized' ELSE reason END AS reason
  FROM f LEFT JOIN b1 USING (user_id, item) LEFT JOIN b2 USING (user_id, item)"""


TABLES["x_personal"] = _personal("x_candidates")


def personalised(t: Inputs, candidates: DataFrame) -> DataFrame:
    hist = ft.history(pf.interactions(t))
    return rk.personalise(candidates, hist, pr.behaviour(t), ft.tag_affinity(hist, pf.items(t)), pf.items(t), pf.now())


@stored
def personal(t: Inputs) -> DataFrame:
    return personalised(t, rk.expand_requests(fused(t), requests(t)))


@query("rnk7_personalised", f"SELECT request_id, user_id, item, {R('score')} AS score, reason FROM x_personal")
def _(t: Inputs) -> DataFrame:
    return personal.direct(t)


TABLES["x_static"] = """
  SELECT p.dataset_id, ln(1 + greatest(price, 0)) AS price_log, description_length, tag_count,
         ln(1 + total_weight) AS weight_log, interaction_count, popularity_rank, popularity_percentile,
         CASE WHEN price <= 0.5 THEN 0.0 WHEN price <= 1 THEN 1.0 WHEN price <= 2 THEN 2.0 WHEN price <= 5 THEN 3.0 ELSE 4.0 END AS price_bucket,
         interaction_count / 30.0::DOUBLE AS interaction_density, description_length * tag_count AS content_richness,
         coalesce(slot_total_exposures, 0) AS slot_total_exposures, coalesce(slot_mean_ctr, 0) AS slot_mean_ctr
  FROM x_item_pop p LEFT JOIN x_slot_rollup USING (dataset_id)"""
_STATIC = """price_log description_length tag_count weight_log interaction_count popularity_percentile price_bucket
             interaction_density content_richness slot_total_exposures slot_mean_ctr"""


@stored
def static(t: Inputs) -> DataFrame:
    slots = fn.slot_rollup(pfun.first_events(t)["recommend_slot_metrics"])
    images = pr.image_features(t).select("dataset_id", "image_richness_score", "has_images", "has_cover")
    vectors = ft.vector_stats(t.vectors)
    optional = images.join(vectors, "dataset_id", "left")
    return rk.static_features(pf.items(t), pf.item_stats(t), slots, optional)


@query("rnk8_static_features", f"""
  SELECT dataset_id, {', '.join(f'{R(c)} AS {c}' for c in _STATIC.split())}, popularity_rank FROM x_static""")
def _(t: Inputs) -> DataFrame:
    return static(t).select("dataset_id", *_STATIC.split(), "popularity_rank")


@query("rnk9_request_features", f"""
  WITH c AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item) - 1 AS position,
                    split_part(reason, '+', 1) AS channel FROM x_personal)
  SELECT c.request_id, c.item, {R('c.score')} AS score, position, channel,
         {R("CASE channel WHEN 'behavior' THEN 1.2 WHEN 'content' THEN 1.0 WHEN 'vector' THEN 0.8 WHEN 'popular' THEN 0.02 ELSE 0.1 END")} AS channel_weight,
         r.endpoint, r.device_type, {R('s.price_log')} AS price_log, {R('coalesce(u.total_spent, 0)')} AS user_total_spent
  FROM c JOIN x_requests r USING (request_id) LEFT JOIN x_static s ON s.dataset_id = c.item
  LEFT JOIN x_user_features u ON u.user_id = c.user_id""")
def _(t: Inputs) -> DataFrame:
    out = rk.request_features(personal(t), static(t), requests(t), pf.user_features(t))
    return out.select("request_id", "item", "score", "position", "channel", "channel_weight", "endpoint", "device_type",
                      "price_log", "user_total_spent")


def predictions(t: Inputs, candidates: DataFrame) -> DataFrame:
    """Stand-in prediction (popularity percentile), so the arithmetic can be checked in SQL."""
    items = pf.item_features(t).select(F.col("dataset_id").alias("item"), F.col("popularity_percentile").alias("prediction"),
                                       tx.freshness("days_since_created").alias("freshness"))
    return candidates.select("request_id", "item").join(items, "item", "left")


TABLES["x_ranked"] = """
  SELECT c.request_id, c.user_id, c.item,
         round(c.score + coalesce(m.popularity_percentile * (0.8::DOUBLE + 0.2::DOUBLE * CASE WHEN m.days_since_created <= 7 THEN 1.0
               WHEN m.days_since_created <= 30 THEN 0.5 ELSE 0.2 END), 0), 9) AS score,
         CASE WHEN m.popularity_percentile IS NOT NULL THEN reason || '+rank' ELSE reason END AS reason
  FROM x_personal c LEFT JOIN x_item_features m ON m.dataset_id = c.item"""


@stored
def scored(t: Inputs) -> DataFrame:
    base = personal(t)
    return rk.add_rank_scores(base, predictions(t, base))


@query("rnk10_rank_scores", f"SELECT request_id, user_id, item, {R('score')} AS score, reason FROM x_ranked")
def _(t: Inputs) -> DataFrame:
    return scored.direct(t)


def _strong(base: str) -> str:
    return f"""
  WITH m AS (SELECT *, quantile_cont(score, 0.3) OVER (PARTITION BY request_id) AS cut, count(*) OVER (PARTITION BY request_id) AS n,
                    row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item) AS rk FROM {base}),
  w AS (SELECT *, count(*) FILTER (score < cut) OVER (PARTITION BY request_id) AS weak_n FROM m)
  SELECT request_id, user_id, item, score, reason FROM w
  WHERE n < 10 OR NOT (score < cut) OR (weak_n > n * 0.5 AND rk <= greatest(5, n // 2))"""


TABLES["x_strong"] = _strong("x_ranked")


@query("rnk11_weak_dropped", f"SELECT request_id, item, {R('score')} AS score FROM x_strong")
def _(t: Inputs) -> DataFrame:
    return rk.drop_weak(scored(t)).select("request_id", "item", "score")


TABLES["x_lambda"] = """
  SELECT request_id, round(CASE WHEN device_type = 'mobile' THEN greatest(b - 0.1, 0.2) ELSE b END, 6) AS mmr_lambda
  FROM (SELECT *, CASE WHEN source = 'search' THEN 0.6::DOUBLE WHEN source IN ('landing', 'home') THEN 0.3::DOUBLE
                       WHEN endpoint = 'recommend_detail' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS b FROM x_requests)"""


@query("rnk13_mmr_lambda", f"SELECT request_id, {R('mmr_lambda')} AS mmr_lambda FROM x_lambda")
def _(t: Inputs) -> DataFrame:
    return requests(t).select("request_id", rk.mmr_lambda("endpoint", "source", "device_type").alias("mmr_lambda"))


def _mmr(base: str) -> str:
    """The greedy pick as a recursive query: a step takes the first row of each request and scores the rest anew."""
    return f"""
  WITH RECURSIVE c AS (
    SELECT b.request_id, b.item, b.score, b.reason, mmr_lambda AS lam,
           CASE WHEN max(b.score) OVER w > min(b.score) OVER w THEN (b.score - min(b.score) OVER w) / (max(b.score) OVER w - min(b.score) OVER w) ELSE 0.0 END AS rel,
           coalesce(list_distinct({SQL_TAGS('i.tag')}), []) AS tags
    FROM {base} b JOIN x_lambda USING (request_id) LEFT JOIN x_items i ON i.dataset_id = b.item WINDOW w AS (PARTITION BY b.request_id)),
  m AS (
    SELECT *, 0.0::DOUBLE AS closest, 1 AS step, row_number() OVER (PARTITION BY request_id ORDER BY round(lam * rel, 9) DESC, item) AS rn FROM c
    UNION ALL
    SELECT request_id, item, score, reason, lam, rel, tags, closest, step + 1,
           row_number() OVER (PARTITION BY request_id ORDER BY round(lam * rel - (1 - lam) * closest, 9) DESC, item)
    FROM (SELECT request_id, item, score, reason, lam, rel, tags, step, rn,
                 greatest(closest, CASE WHEN len(tags) + len(taken) = 0 THEN 0.0
                   ELSE len(list_intersect(tags, taken)) / CAST(len(tags) + len(taken) - len(list_intersect(tags, taken)) AS DOUBLE) END) AS closest
          FROM (SELECT *, first_value(tags) OVER (PARTITION BY request_id ORDER BY rn) AS taken FROM m)) WHERE rn > 1 AND step < 10)
  SELECT request_id, item, score, reason, step AS rank FROM m WHERE rn = 1"""


@stored
def diversified(t: Inputs) -> DataFrame:
    lam = requests(t).select("request_id", rk.mmr_lambda("endpoint", "source", "device_type").alias("mmr_lambda"))
    return rk.diversify(rk.drop_weak(scored(t)).join(lam, "request_id"), pf.items(t), LIMIT)


@query("rnk12_diversified", f"SELECT request_id, item, {R('score')} AS score, reason, rank FROM ({_mmr('x_strong')})")
def _(t: Inputs) -> DataFrame:
    """Greedy MMR per request."""
    return diversified.direct(t)


TABLES["x_final"] = """
  SELECT request_id, item, score, reason, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item) AS rank
  FROM x_strong QUALIFY rank <= 10"""


TABLES["x_ring"] = """
  SELECT dataset_id AS item, row_number() OVER (ORDER BY substr(md5(dataset_id::VARCHAR), 1, 12), dataset_id) - 1 AS place, count(*) OVER () AS n FROM x_items"""


def _explored(base: str, epsilon: float) -> str:
    return f"""
  WITH l AS (SELECT *, max(rank) OVER (PARTITION BY request_id) AS size FROM {base}),
  k AS (SELECT *, CAST(floor(size * {epsilon}) AS BIGINT) AS fill FROM l),
  kept AS (SELECT request_id, item, score, reason, rank FROM k WHERE rank <= size - fill),
  w AS (SELECT DISTINCT request_id, size, fill, CAST('0x' || substr(md5(request_id::VARCHAR), 1, 12) AS BIGINT) AS point FROM k WHERE fill > 0),
  d AS (SELECT w.*, r.item, row_number() OVER (PARTITION BY w.request_id ORDER BY (r.place - w.point % r.n + r.n) % r.n) AS x
        FROM w CROSS JOIN x_ring r WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.request_id = w.request_id AND o.item = r.item))
  SELECT request_id, item, score, reason, rank FROM kept
  UNION ALL SELECT request_id, item, 0.5, 'exploration', size - fill + x FROM d WHERE x <= fill"""


@query("rnk14_explored", f"SELECT request_id, item, {R('score')} AS score, reason, rank FROM ({_explored('x_final', 0.2)})")
def _(t: Inputs) -> DataFrame:
    """Exploration of lists by score, from the whole catalogue."""
    from wayfunnel.operators.relational import top_per_group
    final = top_per_group(rk.drop_weak(scored(t)), ["request_id"], [F.desc("score"), F.asc("item")], LIMIT)
    return rk.explore(final.select("request_id", "item", "score", "reason", "rank"), pf.items(t), 0.2, LIMIT)


def _shown(base: str) -> str:
    return f"""
  SELECT f.request_id, f.rank, f.item, m.dataset_name AS title, {R('m.price')} AS price,
         (SELECT image_url FROM x_images g WHERE g.dataset_id = m.id ORDER BY image_order, image_key LIMIT 1) AS cover_image,
         {R('f.score')} AS score, f.reason FROM {base} f LEFT JOIN x_raw_items m ON m.id = f.item AND m.is_delete = 0"""


@query("rnk15_response", _shown("x_final"))
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.relational import top_per_group
    final = top_per_group(rk.drop_weak(scored(t)), ["request_id"], [F.desc("score"), F.asc("item")], LIMIT)
    return rk.response(final.select("request_id", "item", "score", "reason", "rank"), live_items(t))


def _fallback(unanswered: str) -> str:
    return f"""
  WITH e AS (SELECT request_id, target FROM x_requests WHERE {unanswered}),
  s AS (SELECT request_id, item, rank, 'fallback_precomputed' AS reason FROM e JOIN x_precomputed USING (target) WHERE rank <= 10),
  p AS (SELECT request_id, dataset_id, rank, 'fallback_popular' FROM e CROSS JOIN x_popular WHERE rank <= 10
        AND request_id NOT IN (SELECT request_id FROM s))
  SELECT request_id, item, greatest(0, 0.05::DOUBLE - (rank - 1) * 0.005::DOUBLE) AS score, reason, rank
  FROM (SELECT * FROM s UNION ALL SELECT * FROM p)"""


@query("rnk16_fallback", f"SELECT request_id, item, rank, reason, {R('score')} AS score FROM ({_fallback('user_id % 3 = 0')})")
def _(t: Inputs) -> DataFrame:
    asks = requests(t)
    answered = asks.filter(~every("user_id", 3))
    return rk.fallback(asks, answered, pr.precomputed(t), pr.popular(t), LIMIT)


# -- the whole batch job ------------------------------------------------------------

_HASH = "CAST(('0x' || substr(sha256('exp:' || {key}), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE"


def _variant(key: str) -> str:
    h = _HASH.format(key=key)
    return f"CASE WHEN {h} <= 0.5 THEN 'control' WHEN {h} <= 0.8 THEN 'test' ELSE 'bold' END"


#: Linear stand-in for the fitted ranker, so that the job can be checked in SQL.
LINEAR = {"popularity_percentile": 0.4, "channel_weight": 0.1, "price_log": 0.02, "position": -0.001, "user_total_spent": 1e-7}

TABLES["x_job_base"] = f"""
  SELECT request_id, coalesce(any_value(w.weight) FILTER (w.channel = 'behavior'), 1.2) AS wb,
         CASE WHEN {_variant('user_id')} = 'test' THEN 1.5 ELSE coalesce(any_value(w.weight) FILTER (w.channel = 'content'), 1.0) END::DOUBLE AS wc,
         coalesce(any_value(w.weight) FILTER (w.channel = 'vector'), 0.8) AS wv, coalesce(any_value(w.weight) FILTER (w.channel = 'popular'), 0.02) AS wp
  FROM x_requests CROSS JOIN x_channel_weights w GROUP BY request_id, user_id"""
TABLES["x_job_weights"] = _moved("SELECT * FROM x_job_base")
TABLES["x_offers"] = f"""
  WITH n AS (
    SELECT src AS target, dst AS item, {_norm('', 'score', 'src')} AS s, 0 AS p, 'behavior' AS c FROM x_behaviour
    UNION ALL SELECT src, dst, {_norm('', 'score', 'src')}, 1, 'content' FROM x_content
    UNION ALL SELECT src, dst, {_norm('', 'score', 'src')}, 2, 'vector' FROM x_vector_sim),
  g AS (SELECT target, item, coalesce(sum(s) FILTER (c = 'behavior'), 0) AS nb, coalesce(sum(s) FILTER (c = 'content'), 0) AS nc,
               coalesce(sum(s) FILTER (c = 'vector'), 0) AS nv, string_agg(c, '+' ORDER BY p) AS reason FROM n GROUP BY 1, 2)
  SELECT target, item, nb, nc, nv, 0.0::DOUBLE AS np, reason FROM g
  UNION ALL
  SELECT m.dataset_id, p.dataset_id, 0, 0, 0, p.score, 'popular' FROM x_items m JOIN x_gated p ON m.dataset_id <> p.dataset_id
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.target = m.dataset_id AND g.item = p.dataset_id)
  QUALIFY row_number() OVER (PARTITION BY m.dataset_id ORDER BY p.rank) <= 50"""
TABLES["x_job_fused"] = """
  SELECT request_id, user_id, item, round(nb * wb + nc * wc + nv * wv + np * wp, 9) AS score, reason
  FROM x_job_weights JOIN x_offers USING (target)"""
TABLES["x_job_personal"] = _personal("x_job_fused")
TABLES["x_job_found"] = _augmented("x_job_personal")
TABLES["x_job_predicted"] = """
  SELECT c.*, round(0.4::DOUBLE * coalesce(s.popularity_percentile, 0) + 0.02::DOUBLE * coalesce(s.price_log, 0) - 0.001::DOUBLE * position
                    + 1e-7::DOUBLE * coalesce(u.total_spent, 0) + 0.1::DOUBLE *
                    CASE channel WHEN 'behavior' THEN wb WHEN 'content' THEN wc WHEN 'vector' THEN wv WHEN 'popular' THEN wp ELSE 0.1 END, 9) AS prediction
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item) - 1 AS position, split_part(reason, '+', 1) AS channel
        FROM x_job_found) c
  JOIN x_job_weights USING (request_id) LEFT JOIN x_static s ON s.dataset_id = c.item LEFT JOIN x_user_features u ON u.user_id = c.user_id"""
TABLES["x_job_ranked"] = """
  SELECT c.request_id, c.user_id, c.item, c.prediction, round(c.score + c.prediction * (0.8::DOUBLE + 0.2::DOUBLE * CASE
           WHEN m.dataset_id IS NULL OR m.days_since_created <= 7 THEN 1.0 WHEN m.days_since_created <= 30 THEN 0.5 ELSE 0.2 END), 9) AS score,
         reason || '+rank' AS reason
  FROM x_job_predicted c LEFT JOIN x_item_features m ON m.dataset_id = c.item"""
TABLES["x_job_strong"] = _strong("x_job_ranked")
TABLES["x_job_lists"] = _mmr("x_job_strong")
TABLES["x_job_explored"] = _explored("x_job_lists", 0.15)
TABLES["x_job_all"] = f"""
  SELECT e.request_id, e.item, coalesce(r.prediction, e.score) AS score, e.reason, e.rank
  FROM x_job_explored e LEFT JOIN x_job_ranked r ON e.reason <> 'exploration' AND r.request_id = e.request_id AND r.item = e.item
  UNION ALL SELECT * FROM ({_fallback('request_id NOT IN (SELECT request_id FROM x_job_explored)')})"""


def weighted_requests(t: Inputs) -> DataFrame:
    """Requests with their weights: trained, overridden by the user's experiment variant, moved by the signals."""
    asks = requests(t).withColumn("variant", ex.assign_variant("user_id", "exp", VARIANTS))
    variants = asks.select("variant").distinct()
    base = variants.select("variant", F.explode(F.create_map(*[
        x for k, v in rk.CHANNEL_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])).alias("channel", "weight"))
    params = variants.filter("variant = 'test'").select("variant", F.lit("content").alias("channel"), F.lit(1.5).alias("weight"))
    own = rk.weights_by_variant(rk.overridden_weights(base, trained_weights(t), params))
    signal = signals(t).drop("target", "user_id").join(asks, "request_id").join(own, "variant")
    moved = rk.dynamic_weights(signal, {c: F.col(f"base_{c}") for c in rk.CHANNEL_WEIGHTS})
    return moved.select(*asks.columns, *[f"w_{c}" for c in rk.CHANNEL_WEIGHTS])


@stored
def job_requests(t: Inputs) -> DataFrame:
    return weighted_requests(t)


@stored
def job_offers(t: Inputs) -> DataFrame:
    return rk.offers({"behavior": pr._as_channel(pr.behaviour(t)), "content": pr._as_channel(pr.content(t)),
                      "vector": pr._as_channel(pr.vector_table(t))},
                     gated(t), pf.items(t).select(F.col("dataset_id").alias("target")), LIMIT)


def recommended(t: Inputs, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    asks = job_requests(t)
    return rk.recommend(
        asks, job_offers(t), extra_channels(t), lambda found: personalised(t, found),
        lambda found: rk.request_features(found, static(t), asks, pf.user_features(t)), rank,
        rk.freshness_of(pf.item_features(t)), pf.items(t), live_items(t), pr.precomputed(t), pr.popular(t), LIMIT)


@query("rnk17_batch_recommend", _shown("x_job_all"))
def _(t: Inputs) -> DataFrame:
    """The whole job for every request, ranked by the linear stand-in."""
    return recommended(t, lambda features: rk.linear_prediction(features, LINEAR))


@query("rnk17b_request_weights", f"""
  SELECT request_id, {R('wb')} AS w_behavior, {R('wc')} AS w_content, {R('wv')} AS w_vector, {R('wp')} AS w_popular FROM x_job_weights""")
def _(t: Inputs) -> DataFrame:
    return weighted_requests(t).select("request_id", *[f"w_{c}" for c in rk.CHANNEL_WEIGHTS])


# -- experiments ----------------------------------------------------------------

@query("exp1_assigned_variant", f"SELECT c_custkey AS user_id, {_variant('c_custkey')} AS variant FROM customer")
def _(t: Inputs) -> DataFrame:
    return t.table("customer").select(F.col("c_custkey").alias("user_id"),
                                      ex.assign_variant("c_custkey", "exp", VARIANTS).alias("variant"))


@query("exp2_normalised_allocations", f"""
  WITH v AS (SELECT endpoint AS experiment, variant, row_number() OVER (PARTITION BY endpoint ORDER BY variant) AS position, count(*) AS n
             FROM x_exposures WHERE endpoint IS NOT NULL AND variant IS NOT NULL GROUP BY 1, 2)
  SELECT experiment, variant, {R('n / CAST(sum(n) OVER (PARTITION BY experiment) AS DOUBLE)')} AS share FROM v""")
def _(t: Inputs) -> DataFrame:
    """Observed variant counts as raw allocations, normalised per endpoint."""
    from pyspark.sql import Window
    counts = t.exposures.filter("endpoint is not null and variant is not null").groupBy(
        F.col("endpoint").alias("experiment"), "variant").agg(F.count(F.lit(1)).cast("double").alias("allocation"))
    w = Window.partitionBy("experiment").orderBy("variant")
    return ex.normalise_allocations(counts.withColumn("position", F.row_number().over(w))).select("experiment", "variant", "share")


TABLES["x_variant_totals"] = """
  SELECT variant, CAST(sum(exposure_count) AS BIGINT) AS exposure_count, CAST(sum(click_count) AS BIGINT) AS click_count
  FROM x_variant_metrics WHERE endpoint = 'recommend_detail' GROUP BY 1"""


def totals(t: Inputs) -> DataFrame:
    return ex.variant_totals(pfun.first_events(t)["recommend_variant_metrics"], "recommend_detail")


@query("exp3_variant_totals", "SELECT * FROM x_variant_totals")
def _(t: Inputs) -> DataFrame:
    return totals(t)


@query("exp4_new_allocations", f"""
  WITH s AS (SELECT variant, CASE WHEN exposure_count < 10 THEN 0 ELSE (click_count + 1) / CAST(exposure_count + 20 AS DOUBLE) END AS score,
                    1.0::DOUBLE / (SELECT count(*) FROM x_variant_totals) AS allocation FROM x_variant_totals),
  n AS (SELECT *, score / sum(score) OVER () * 0.9 + 0.1 / count(*) OVER () AS s FROM s)
  SELECT variant, {R('score')} AS score, {R('allocation')} AS allocation, {R('s / sum(s) OVER ()')} AS new_allocation FROM n""")
def _(t: Inputs) -> DataFrame:
    seen = totals(t)
    n = seen.agg(F.count(F.lit(1)).alias("n")).scalar()
    variants = seen.select("variant").withColumn("allocation", 1.0 / n)
    return ex.new_allocations(seen, variants, 10, 1.0, 20.0, 0.1)


@stored
def trained_weights(t: Inputs) -> DataFrame:
    return ex.channel_weights(t.exposures, t.clicks, t.conversions, min_exposures=300)


@query("exp5_channel_weights", f"SELECT channel, {R('weight')} AS weight FROM x_channel_weights")
def _(t: Inputs) -> DataFrame:
    return trained_weights.direct(t)
