"""Queries for candidate generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import EVENT_AS_OF, Inputs, every, stored
from wayfunnel.functions.common import timestamp_lit
from wayfunnel.operators import cells as cl
from wayfunnel.operators import nearest as nn
from wayfunnel.operators import recall as rc
from wayfunnel.plans import features as pf
from wayfunnel.plans.oracle import EVENT_AS_OF as SQL_EVENT_AS_OF
from wayfunnel.plans.oracle import R, TABLES
from wayfunnel.plans.registry import query

K = 20          # neighbours kept in the registered queries
LIMIT = 56      # candidate limit: quotas of 8 and 7 rows per channel


def inter(t: Inputs) -> DataFrame:
    """Pairs of a quarter-year window of users' order history (whole table)."""
    return pf.interactions(t)


def _rank(score: str = "score", part: str = "src", tie: str = "dst", k: int = K) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {score} DESC, {tie}) <= {k}"


TABLES["x_behaviour"] = f"""
  WITH p AS (SELECT a.dataset_id AS src, b.dataset_id AS dst, count(*) AS n FROM x_inter a JOIN x_inter b
             ON a.user_id = b.user_id AND a.dataset_id <> b.dataset_id GROUP BY 1, 2),
  k AS (SELECT * FROM p {_rank('n')})
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS score FROM k"""


@stored
def behaviour(t: Inputs) -> DataFrame:
    return rc.behaviour_neighbours(inter(t), K)


@query("rec1_behaviour_neighbours", f"""
  SELECT src, dst, {R('score')} AS score FROM x_behaviour""")
def _(t: Inputs) -> DataFrame:
    return behaviour.direct(t).select("src", "dst", "score")


@query("jn7_self_join_per_user", "SELECT src, dst, score FROM (SELECT src, dst, " + R("score") + " AS score FROM x_behaviour)")
def _(t: Inputs) -> DataFrame:
    """The per-user self join with a low split between light and heavy users."""
    return rc.behaviour_neighbours(inter(t), K, heavy=40).select("src", "dst", "score")


TABLES["x_user_sim"] = f"""
  WITH p AS (SELECT a.user_id AS src, b.user_id AS dst, count(*) AS n FROM x_inter a JOIN x_inter b
             ON a.dataset_id = b.dataset_id AND a.user_id <> b.user_id GROUP BY 1, 2 HAVING count(*) >= 2),
  z AS (SELECT user_id, count(*) AS size FROM x_inter GROUP BY 1),
  s AS (SELECT src, dst, n / CAST(a.size + b.size - n AS DOUBLE) AS score
        FROM p JOIN z a ON src = a.user_id JOIN z b ON dst = b.user_id)
  SELECT * FROM s {_rank(k=50)}"""


@stored
def user_sim(t: Inputs) -> DataFrame:
    return rc.user_neighbours(inter(t))


@query("rec2_user_neighbours", f"SELECT src, dst, {R('score')} AS score FROM x_user_sim")
def _(t: Inputs) -> DataFrame:
    return user_sim.direct(t).select("src", "dst", "score")


TABLES["x_user_cand"] = f"""
  WITH s AS (SELECT n.src AS user_id, i.dataset_id, round(sum(score), 9) AS score
             FROM x_user_sim n JOIN x_inter i ON i.user_id = n.dst
             WHERE NOT EXISTS (SELECT 1 FROM x_inter o WHERE o.user_id = n.src AND o.dataset_id = i.dataset_id)
             GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, dataset_id) AS rank FROM s
  QUALIFY rank <= {K}"""


@query("rec3_user_candidates", f"SELECT user_id, dataset_id, {R('score')} AS score, rank FROM x_user_cand")
def _(t: Inputs) -> DataFrame:
    return rc.user_candidates(user_sim(t), inter(t), K)


@query("rec4_tag_index", "SELECT tag, dataset_id FROM x_item_tags")
def _(t: Inputs) -> DataFrame:
    return rc.tag_index(pf.items(t))


TABLES["x_tag_sim"] = f"""
  WITH p AS (SELECT a.dataset_id AS src, b.dataset_id AS dst, count(*) AS n FROM x_item_tags a JOIN x_item_tags b
             ON a.tag = b.tag AND a.dataset_id <> b.dataset_id GROUP BY 1, 2),
  z AS (SELECT dataset_id, count(*) AS size FROM x_item_tags GROUP BY 1),
  s AS (SELECT src, dst, n / CAST(a.size + b.size - n AS DOUBLE) AS score
        FROM p JOIN z a ON src = a.dataset_id JOIN z b ON dst = b.dataset_id)
  SELECT * FROM s {_rank()}"""


@query("rec5_tag_neighbours", f"SELECT src, dst, {R('score')} AS score FROM x_tag_sim")
def _(t: Inputs) -> DataFrame:
    """Popular tags exceed the split, so the class path carries most of this query."""
    return rc.tag_neighbours(pf.items(t), K, heavy=100).select("src", "dst", "score")


TABLES["x_category_sim"] = f"""
  SELECT a.dataset_id AS src, b.dataset_id AS dst, 1.0::DOUBLE AS score FROM x_items a JOIN x_items b
    ON lower(a.create_company_name) = lower(b.create_company_name) AND a.dataset_id <> b.dataset_id
  WHERE a.create_company_name <> '' {_rank('1')}"""


@query("rec6_category_neighbours", "SELECT src, dst, score FROM x_category_sim")
def _(t: Inputs) -> DataFrame:
    return rc.category_neighbours(pf.items(t), K).select("src", "dst", "score")


_BUCKET = "CASE WHEN price < 100 THEN 0 WHEN price < 500 THEN 1 WHEN price < 1000 THEN 2 WHEN price < 5000 THEN 3 ELSE 4 END"
TABLES["x_price_sim"] = f"""
  WITH b AS (SELECT dataset_id, {_BUCKET} AS g FROM x_items)
  SELECT a.dataset_id AS src, b.dataset_id AS dst, 1.0::DOUBLE AS score FROM b a JOIN b ON a.g = b.g AND a.dataset_id <> b.dataset_id
  {_rank('1')}"""


@query("rec7_price_neighbours", "SELECT src, dst, score FROM x_price_sim")
def _(t: Inputs) -> DataFrame:
    return rc.price_neighbours(pf.items(t), K).select("src", "dst", "score")


TABLES["x_image_sim"] = f"""
  WITH s AS (SELECT a.dataset_id AS src, b.dataset_id AS dst,
                    round(1 / (1 + abs(a.image_richness_score - b.image_richness_score)
                               + abs(a.image_count * 0.1::DOUBLE - b.image_count * 0.1::DOUBLE)), 9) AS score
             FROM x_image_features a JOIN x_image_features b ON a.dataset_id <> b.dataset_id
             WHERE a.has_images = 1 AND b.has_images = 1
             UNION ALL
             SELECT a.dataset_id, b.dataset_id, round(b.image_richness_score, 9)
             FROM x_image_features a JOIN x_image_features b ON a.dataset_id <> b.dataset_id
             WHERE a.has_images = 0 AND b.has_images = 1 AND b.image_richness_score > 0.5)
  SELECT * FROM s {_rank()}"""


@stored
def image_features(t: Inputs) -> DataFrame:
    from wayfunnel.operators import features as ft
    return ft.image_features(pf.items(t), t.images, pf.now())


@query("rec8_image_neighbours", f"SELECT src, dst, {R('score')} AS score FROM x_image_sim")
def _(t: Inputs) -> DataFrame:
    return rc.image_neighbours(image_features(t), K, block_rows=512).select("src", "dst", "score")


_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
TABLES["x_terms"] = f"""
  SELECT dataset_id, term, count(*) AS tf FROM (SELECT dataset_id, unnest({_TOK.format("description || ' ' || tag")}) AS term FROM x_items)
  GROUP BY 1, 2"""
TABLES["x_tfidf"] = """
  WITH v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM x_terms GROUP BY 1 ORDER BY total DESC, term LIMIT 5000),
  w AS (SELECT dataset_id, term, tf * (ln((1 + (SELECT count(*) FROM x_items)) / CAST(1 + df AS DOUBLE)) + 1) AS w
        FROM x_terms JOIN v USING (term))
  SELECT dataset_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY dataset_id)) AS w FROM w"""
TABLES["x_text_pairs"] = """
  SELECT a.dataset_id AS src, b.dataset_id AS dst, sum(a.w * b.w) AS score FROM x_tfidf a JOIN x_tfidf b
    ON a.term = b.term AND a.dataset_id <> b.dataset_id GROUP BY 1, 2"""
TABLES["x_content"] = f"""
  SELECT src, dst, round(score, 9) AS score FROM x_text_pairs WHERE round(score, 9) >= 0.01 {_rank('round(score, 9)')}"""


@stored
def content(t: Inputs) -> DataFrame:
    return rc.content_neighbours(pf.items(t), K)


@stored
def vector_table(t: Inputs) -> DataFrame:
    return rc.vector_neighbours(t.vectors, K)


@query("rec9_content_neighbours", f"SELECT src, dst, {R('score')} AS score FROM x_content")
def _(t: Inputs) -> DataFrame:
    return content.direct(t).select("src", "dst", "score")


TABLES["x_unit"] = """
  SELECT vec_id AS dataset_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) WHERE n > 0"""
TABLES["x_vector_pairs"] = """
  SELECT a.dataset_id AS src, b.dataset_id AS dst, list_dot_product(a.v, b.v) AS score
  FROM x_unit a JOIN x_unit b ON a.dataset_id <> b.dataset_id"""
TABLES["x_vector_sim"] = f"""
  SELECT src, dst, round(score, 9) AS score FROM x_vector_pairs WHERE round(score, 9) >= 0.01 {_rank('round(score, 9)')}"""


@query("rec10_multimodal_neighbours", f"""
  WITH s AS (SELECT coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst,
                    round(0.6::DOUBLE * coalesce(x.score, 0) + 0.4::DOUBLE * coalesce(y.score, 0), 9) AS score
             FROM x_text_pairs x FULL JOIN (SELECT * FROM x_vector_pairs WHERE src IN (SELECT dataset_id FROM x_items)
               AND dst IN (SELECT dataset_id FROM x_items)) y ON x.src = y.src AND x.dst = y.dst)
  SELECT src, dst, {R('score')} AS score FROM s WHERE score > 0.01 {_rank('s.score')}""")
def _(t: Inputs) -> DataFrame:
    return rc.multimodal_neighbours(pf.items(t), t.vectors, K).select("src", "dst", "score")


@query("rec11_vector_neighbours", f"SELECT src, dst, {R('score')} AS score FROM x_vector_sim")
def _(t: Inputs) -> DataFrame:
    """Small blocks, so pivots, pruning and the second pass all run."""
    return rc.vector_neighbours(t.vectors, K, block_rows=128).select("src", "dst", "score")


@query("jn8_all_pairs_top_k", f"SELECT src, dst, {R('score')} AS score FROM x_vector_sim")
def _(t: Inputs) -> DataFrame:
    return rc.vector_neighbours(t.vectors, K).select("src", "dst", "score")


@query("rec12_neighbour_table", f"""
  SELECT src, dst, {R('score')} AS score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank
  FROM x_content WHERE score > 0 QUALIFY rank <= 10""")
def _(t: Inputs) -> DataFrame:
    return rc.neighbour_table(content(t), 10)


@query("rec13_vector_search", f"""
  SELECT src, dst, {R('round(score, 9)')} AS score FROM x_vector_pairs
  WHERE src IN (SELECT doc_id FROM labels WHERE quality = 1) {_rank('round(score, 9)')}""")
def _(t: Inputs) -> DataFrame:
    ids = t.table("labels").filter("quality = 1").select(F.col("doc_id").alias("dataset_id"))
    return rc.vector_search(t.vectors, ids, K).select("src", "dst", "score")


_BIG = r"""list_concat({w}, list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1]))"""
TABLES["x_grams"] = f"""
  WITH w AS (SELECT dataset_id, {_TOK.format("description || ' ' || tag || ' ' || dataset_name")} AS w FROM x_items)
  SELECT dataset_id, term, count(*) AS tf FROM (SELECT dataset_id, unnest({_BIG.format(w='w')}) AS term FROM w) GROUP BY 1, 2"""
TABLES["x_gram_vocab"] = """
  SELECT term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM x_grams GROUP BY 1),
       (SELECT count(*) AS n FROM x_items) WHERE df >= 2 AND df <= 0.8 * n ORDER BY total DESC, term LIMIT 5000"""


@query("rec14_text_search", f"""
  WITH d AS (SELECT dataset_id, term, tf * idf AS w FROM x_grams JOIN x_gram_vocab USING (term)),
  du AS (SELECT dataset_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY dataset_id)) AS w FROM d),
  qw AS (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark),
  qc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_BIG.format(w='w')}) AS term FROM qw) GROUP BY 1, 2),
  qv AS (SELECT item_id, term, tf * idf AS w FROM qc JOIN x_gram_vocab USING (term)),
  qu AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qv),
  s AS (SELECT item_id AS src, dataset_id AS dst, round(sum(qu.w * du.w), 9) AS score FROM qu JOIN du USING (term) GROUP BY 1, 2)
  SELECT src, dst, {R('score')} AS score FROM s WHERE score > 0 {_rank('s.score')}""")
def _(t: Inputs) -> DataFrame:
    return rc.text_search(pf.items(t), t.table("benchmark"), "item_id", "text", K).select("src", "dst", "score")


@query("rec15_cell_probe_search")
def _(t: Inputs) -> DataFrame:
    """Approximate: only cells whose fitted bound reaches the score to beat are searched."""
    trained = cl.train(nn.unit_points(t.vectors, "dataset_id", "embedding"), K)
    return cl.cell_probe(trained, K)[0]


def probed(t: Inputs) -> DataFrame:
    """Recall of the probe on every hundredth vector against all vectors, and the share of all rows read for it."""
    points = nn.unit_points(t.vectors, "dataset_id", "embedding")
    asks = points.filter(every("id", 100))
    trained = cl.train(points, K)
    found, read = cl.cell_probe(trained, K, asks)
    work = read.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    size = points.agg(F.count(F.lit(1)).alias("points"))
    exact = nn.nearest(points, K, queries=asks)
    out = cl.recall(found, exact).crossJoin(size).crossJoin(work)      # one row each
    return out.withColumns({"cells": F.lit(len(trained.centres)), "align": F.lit(trained.align),
                            "read_share": F.col("rows") / (F.col("asked") * F.col("points"))})


@query("rec15b_probe_recall", f"""
  SELECT count(*) AS asked, count(*) * least({K}, (SELECT count(*) FROM embeddings) - 1) AS pairs, true AS recall_reached
  FROM embeddings WHERE vec_id % 100 = 0""")
def _(t: Inputs) -> DataFrame:
    """Recall of 0.9 or more."""
    return probed(t).select("asked", "pairs", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("rec15c_probe_reading")
def _(t: Inputs) -> DataFrame:
    return probed(t).select("points", "cells", "align", "recall", "read_share")


TABLES["x_popular_pool"] = """
  SELECT dataset_id, w.total_weight, m.price, m.interaction_count, m.days_since_last_purchase
  FROM (SELECT dataset_id, round(sum(weight), 6) AS total_weight FROM x_inter GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 150) w LEFT JOIN x_item_features m USING (dataset_id)"""
_PASS = """NOT (coalesce(price, 0) < 0.5) AND NOT (coalesce(interaction_count, 0) < 10)
           AND NOT (coalesce(days_since_last_purchase, 9999) > 250)"""
TABLES["x_popular"] = f"""
  SELECT dataset_id, total_weight, row_number() OVER (ORDER BY total_weight DESC, dataset_id) AS rank
  FROM x_popular_pool WHERE {_PASS} QUALIFY rank <= 50"""


@stored
def popular(t: Inputs) -> DataFrame:
    return rc.popular_items(inter(t), pf.item_features(t), 50, max_inactive_days=250)


@query("rec16_popular_items", f"SELECT dataset_id, {R('total_weight')} AS total_weight, rank FROM x_popular")
def _(t: Inputs) -> DataFrame:
    return popular.direct(t)


@query("rec17_popular_quality", f"""
  WITH a AS (SELECT count(*) AS total_candidates, count(*) FILTER (coalesce(price, 0) < 0.5) AS low_price,
                    count(*) FILTER (coalesce(interaction_count, 0) < 10) AS low_interaction,
                    count(*) FILTER (coalesce(days_since_last_purchase, 9999) > 250) AS inactive,
                    count(*) FILTER ({_PASS}) AS passed_count, {R(f'coalesce(avg(price) FILTER ({_PASS}), 0)')} AS avg_price,
                    {R(f'coalesce(avg(interaction_count) FILTER ({_PASS}), 0)')} AS avg_interaction,
                    {R(f'coalesce(avg(days_since_last_purchase) FILTER ({_PASS}), 0)')} AS avg_days_inactive FROM x_popular_pool)
  SELECT *, {R('1 - passed_count / CAST(total_candidates AS DOUBLE)')} AS filter_ratio,
         1 - passed_count / CAST(total_candidates AS DOUBLE) > 0.7 AS high_filter_ratio,
         avg_price > 0 AND avg_price < 1 AS low_avg_price, passed_count < 25 AS insufficient_count,
         CASE WHEN passed_count < 5 THEN 'critical' WHEN passed_count < 25 OR 1 - passed_count / CAST(total_candidates AS DOUBLE) > 0.7
              THEN 'warning' WHEN avg_price > 0 AND avg_price < 1 THEN 'info' ELSE 'none' END AS severity FROM a""")
def _(t: Inputs) -> DataFrame:
    return rc.popular_quality(inter(t), pf.item_features(t), 50, max_inactive_days=250)


def _as_channel(df: DataFrame) -> DataFrame:
    return df.select(F.col("src").alias("target"), F.col("dst").alias("item"), "score")


@stored
def channels(t: Inputs) -> DataFrame:
    """Every item as a target over the item-driven channels."""
    items = pf.items(t)
    got = rc.multi_channel({
        "behavior": _as_channel(behaviour(t)), "content": _as_channel(content(t)),
        "tag": _as_channel(rc.tag_neighbours(items, K)), "category": _as_channel(rc.category_neighbours(items, K)),
        "price": _as_channel(rc.price_neighbours(items, K)),
        "image": _as_channel(rc.image_neighbours(image_features(t), K)),
        "vector_faiss": _as_channel(vector_table(t))}, LIMIT)
    targets = items.select(F.col("dataset_id").alias("target"))
    return got.unionByName(rc.popular_channel(targets, popular(t), LIMIT))


def _quota(table: str, name: str, n: int) -> str:
    return f"""SELECT src AS target, dst AS item, '{name}' AS channel, score FROM {table}
      {_rank(f'{table}.score', k=n)}"""


TABLES["x_channels"] = " UNION ALL ".join(f"SELECT * FROM ({_quota(a, b, n)})" for a, b, n in (
    ("x_behaviour", "behavior", 8), ("x_content", "content", 8), ("x_tag_sim", "tag", 8),
    ("x_category_sim", "category", 8), ("x_price_sim", "price", 8), ("x_image_sim", "image", 7),
    ("x_vector_sim", "vector_faiss", 8))) + """
  UNION ALL SELECT m.dataset_id, p.dataset_id, 'popular', 0.01::DOUBLE - (p.rank - 1) * 0.0001::DOUBLE FROM x_items m
  JOIN x_popular p ON p.rank <= 7 AND p.dataset_id <> m.dataset_id"""


@query("rec18_multi_channel", f"SELECT target, item, channel, {R('score')} AS score FROM x_channels")
def _(t: Inputs) -> DataFrame:
    return channels.direct(t)


_W = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rc.MERGE_WEIGHTS.items())
_P = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(rc.CHANNEL_ORDER))
TABLES["x_merged"] = f"""
  WITH g AS (SELECT target, item, round(sum(score * CASE channel {_W} ELSE 0.5::DOUBLE END), 9) AS score,
                    string_agg(channel, '+' ORDER BY CASE channel {_P} END) AS sources FROM x_channels GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, item) AS rank FROM g QUALIFY rank <= 30"""


@query("rec19_merged_channels", f"SELECT target, item, {R('score')} AS score, sources, rank FROM x_merged")
def _(t: Inputs) -> DataFrame:
    return rc.merge_channels(channels(t), 30)


TABLES["x_precomputed"] = """
  WITH r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM x_behaviour
             UNION ALL SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) FROM x_content
             UNION ALL SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) FROM x_vector_sim)
  SELECT src AS target, dst AS item, min(r) AS best_rank, row_number() OVER (PARTITION BY src ORDER BY min(r), dst) AS rank
  FROM r WHERE r <= 10 GROUP BY 1, 2 QUALIFY rank <= 10"""


@stored
def precomputed(t: Inputs) -> DataFrame:
    return rc.precomputed([_as_channel(behaviour(t)), _as_channel(content(t)),
                           _as_channel(vector_table(t))], 10)


@query("rec20_precomputed_fallback", "SELECT target, item, best_rank, rank FROM x_precomputed")
def _(t: Inputs) -> DataFrame:
    return precomputed.direct(t)


def _trend(hours: int, label: str) -> str:
    return f"""SELECT '{label}' AS timeframe, dataset_id, score FROM (
      SELECT k AS dataset_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 ELSE 3 END) AS BIGINT) AS score FROM x_events
      WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {hours} HOUR AND ts <= TIMESTAMP '2024-01-30 12:00:00'
        AND event_type IN ('view', 'click') GROUP BY 1 ORDER BY score DESC, dataset_id LIMIT 20)"""


@query("rec21_trending", _trend(1, "1h") + " UNION ALL " + _trend(24, "24h"))
def _(t: Inputs) -> DataFrame:
    until = timestamp_lit("2024-01-30 12:00:00")
    parts = [rc.trending(t.events, "k", "event_type", "ts", until, h, 20).select(F.lit(n).alias("timeframe"), "dataset_id", "score")
             for h, n in ((1, "1h"), (24, "24h"))]
    return parts[0].union(parts[1])


@query("rec22_equal_category", """
  WITH c AS (SELECT dataset_id, lower(create_company_name) AS g FROM x_items WHERE create_company_name <> '')
  SELECT a.dataset_id AS src, b.dataset_id AS dst, 1.0::DOUBLE AS score FROM c a JOIN c b ON a.g = b.g AND a.dataset_id <> b.dataset_id
  QUALIFY row_number() OVER (PARTITION BY a.dataset_id ORDER BY b.dataset_id) <= 10""")
def _(t: Inputs) -> DataFrame:
    return rc.category_neighbours(pf.items(t), 10).select("src", "dst", "score")


@query("rec23_popular_unseen", f"""
  WITH p AS (SELECT item_id, round(count(*) * avg(rating), 9) AS score FROM x_ratings GROUP BY 1),
  c AS (SELECT u.user_id, p.item_id, p.score FROM (SELECT DISTINCT user_id FROM x_ratings) u CROSS JOIN p)
  SELECT c.user_id, c.item_id, {R('c.score')} AS score,
         row_number() OVER (PARTITION BY c.user_id ORDER BY c.score DESC, c.item_id) AS rank
  FROM c LEFT JOIN x_ratings r ON r.user_id = c.user_id AND r.item_id = c.item_id WHERE r.user_id IS NULL QUALIFY rank <= 10""")
def _(t: Inputs) -> DataFrame:
    return rc.popular_unseen(pf.ratings(t), 10)


@query("rec24_content_for_users", f"""
  WITH z AS (SELECT user_id, count(*) AS size FROM x_inter GROUP BY 1),
  s AS (SELECT i.user_id, c.dst AS dataset_id, sum(c.score) AS s FROM x_inter i JOIN x_content c ON c.src = i.dataset_id GROUP BY 1, 2),
  f AS (SELECT s.user_id, s.dataset_id, round(s.s / z.size, 9) AS score FROM s JOIN z USING (user_id)
        WHERE NOT EXISTS (SELECT 1 FROM x_inter o WHERE o.user_id = s.user_id AND o.dataset_id = s.dataset_id))
  SELECT user_id, dataset_id, {R('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY f.score DESC, dataset_id) AS rank
  FROM f QUALIFY rank <= 10""")
def _(t: Inputs) -> DataFrame:
    return rc.content_for_users(content(t), inter(t), 10)


@query("rec25_hybrid_content")
def _(t: Inputs) -> DataFrame:
    """Mixed vectors with hashed companies, so rows only."""
    return rc.hybrid_content_neighbours(pf.items(t), K)


@query("rec26_similar_items", f"""
  SELECT src, dst, {R('score')} AS score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank
  FROM x_tag_sim QUALIFY rank <= 5""")
def _(t: Inputs) -> DataFrame:
    return rc.similar_items(rc.tag_neighbours(pf.items(t), K), 5)
