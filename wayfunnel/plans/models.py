"""Queries for collaborative filtering, rankers and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.adapters import Inputs, every, stored
from wayfunnel.operators import evaluation as ev
from wayfunnel.operators import filtering as cf
from wayfunnel.operators import models as ml
from wayfunnel.operators import ranking as rk
from wayfunnel.operators import sgd, stacking
from wayfunnel.operators.experiments import hash_share
from wayfunnel.plans import features as pf
from wayfunnel.plans import funnel as pfun
from wayfunnel.plans import ranking as prk
from wayfunnel.plans import recall as pr
from wayfunnel.plans.oracle import AS_OF as SQL_AS_OF
from wayfunnel.plans.oracle import DAYS, DIV, I, R, TABLES
from wayfunnel.plans.registry import query
from wayfunnel.session import written

N = 10


def _share(salt: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{salt}:' || {key}), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE)"


def _cosine(entity: str, feature: str, table: str = "x_ratings") -> str:
    return f"""
  WITH u AS (SELECT {entity} AS e, {feature} AS f, rating / sqrt(sum(rating * rating) OVER (PARTITION BY {entity})) AS v FROM {table}),
  d AS (SELECT a.e AS src, b.e AS dst, round(sum(a.v * b.v), 9) AS score FROM u a JOIN u b ON a.f = b.f AND a.e <> b.e GROUP BY 1, 2)
  SELECT * FROM d WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 10"""


TABLES["x_cf_users"] = _cosine("user_id", "item_id")
TABLES["x_cf_items"] = _cosine("item_id", "user_id")
_UNSEEN = "NOT EXISTS (SELECT 1 FROM x_ratings o WHERE o.user_id = m.user_id AND o.item_id = m.item_id)"
TABLES["x_user_cf"] = f"""
  WITH m AS (SELECT n.src AS user_id, r.item_id, round(sum(n.score * r.rating) / sum(n.score), 9) AS prediction
             FROM x_cf_users n JOIN x_ratings r ON r.user_id = n.dst GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank FROM m WHERE {_UNSEEN} QUALIFY rank <= 10"""
TABLES["x_item_cf"] = f"""
  WITH m AS (SELECT r.user_id, n.src AS item_id, round(sum(n.score * r.rating) / sum(n.score), 9) AS prediction
             FROM x_cf_items n JOIN x_ratings r ON r.item_id = n.dst GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank FROM m WHERE {_UNSEEN} QUALIFY rank <= 10"""


@stored
def cf_users(t: Inputs) -> DataFrame:
    return cf.cosine_neighbours(pf.ratings(t), "user_id", "item_id")


@stored
def cf_items(t: Inputs) -> DataFrame:
    return cf.cosine_neighbours(pf.ratings(t), "item_id", "user_id")


@stored
def user_cf(t: Inputs) -> DataFrame:
    return cf.user_based(pf.ratings(t), cf_users(t), N)


@stored
def item_cf(t: Inputs) -> DataFrame:
    return cf.item_based(pf.ratings(t), cf_items(t), N)


@query("cf1_user_neighbours", f"SELECT src, dst, {R('score')} AS score FROM x_cf_users")
def _(t: Inputs) -> DataFrame:
    return cf_users.direct(t).select("src", "dst", "score")


@query("cf1b_user_based", f"SELECT user_id, item_id, {R('prediction')} AS prediction, rank FROM x_user_cf")
def _(t: Inputs) -> DataFrame:
    return user_cf.direct(t)


@query("cf1c_user_based_predict", f"""
  WITH p AS (SELECT DISTINCT item AS item_id, buyer AS user_id FROM x_lines WHERE buyer IS NOT NULL),
  g AS (SELECT p.user_id, p.item_id, sum(n.score * r.rating) / sum(n.score) AS guess
        FROM p JOIN x_cf_users n ON n.src = p.user_id JOIN x_ratings r ON r.user_id = n.dst AND r.item_id = p.item_id GROUP BY 1, 2)
  SELECT p.user_id, p.item_id, {R('coalesce(r.rating, g.guess, 0)')} AS prediction
  FROM p LEFT JOIN x_ratings r USING (user_id, item_id) LEFT JOIN g USING (user_id, item_id)""")
def _(t: Inputs) -> DataFrame:
    pairs = t.order_lines.filter("buyer is not null").select(F.col("buyer").alias("user_id"), F.col("item").alias("item_id")).distinct()
    return cf.predict(pairs, pf.ratings(t), cf_users(t))


@query("cf2_item_based", f"SELECT user_id, item_id, {R('prediction')} AS prediction, rank FROM x_item_cf")
def _(t: Inputs) -> DataFrame:
    return cf.item_based(pf.ratings(t), cf_items.direct(t), N)


@query("cf3_factor_model")
def _(t: Inputs) -> DataFrame:
    """Lists from 50 factors after 20 epochs of stratified descent."""
    return sgd.recommend(sgd.factorise(pf.ratings(t)), pf.ratings(t), N)


@query("cf3b_falling_error", """
  SELECT e AS epoch, (SELECT count(*) FROM x_ratings WHERE rating > 0) AS ratings, TRUE AS falling FROM generate_series(0, 19) g(e)""")
def _(t: Inputs) -> DataFrame:
    """Whether the squared error met in an epoch is less than in the one before."""
    losses = sgd.factorise(pf.ratings(t)).losses
    fell = [(epoch, epoch == 0 or loss < losses[epoch - 1][1]) for epoch, loss in losses]
    n = pf.ratings(t).filter("rating > 0").agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.spark.createDataFrame(fell, "epoch long, falling boolean").withColumn("ratings", n)


@query("cf4_truncated_svd")
def _(t: Inputs) -> DataFrame:
    users, items = cf.truncated_svd(pf.ratings(t), rank=8, rounds=3)
    return cf.factor_scores(pf.ratings(t).select("user_id", "item_id"), users, items)


@query("cf5_vector_similarity", f"SELECT src, dst, {R('score')} AS score FROM x_vector_sim")
def _(t: Inputs) -> DataFrame:
    from wayfunnel.operators.recall import vector_neighbours
    return vector_neighbours(t.vectors, pr.K, block_rows=256).select("src", "dst", "score")


TABLES["x_content_users"] = """
  WITH z AS (SELECT user_id, count(*) AS size FROM x_inter GROUP BY 1),
  s AS (SELECT i.user_id, c.dst AS item_id, sum(c.score) AS s FROM x_inter i JOIN x_content c ON c.src = i.dataset_id GROUP BY 1, 2),
  f AS (SELECT s.user_id, s.item_id, round(s.s / z.size, 9) AS score FROM s JOIN z USING (user_id)
        WHERE NOT EXISTS (SELECT 1 FROM x_inter o WHERE o.user_id = s.user_id AND o.dataset_id = s.item_id))
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM f QUALIFY rank <= 20"""
TABLES["x_popular_unseen"] = """
  WITH p AS (SELECT item_id, round(count(*) * avg(rating), 9) AS score FROM x_ratings GROUP BY 1),
  c AS (SELECT u.user_id, p.item_id, p.score FROM (SELECT DISTINCT user_id FROM x_ratings) u CROSS JOIN p)
  SELECT c.user_id, c.item_id, c.score FROM c LEFT JOIN x_ratings r ON r.user_id = c.user_id AND r.item_id = c.item_id
  WHERE r.user_id IS NULL QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY c.score DESC, c.item_id) <= 20"""
TABLES["x_model_lists"] = f"""
  SELECT 'user_cf' AS m, user_id, item_id, prediction AS s, 0.4::DOUBLE AS w FROM (
    SELECT n.src AS user_id, r.item_id, round(sum(n.score * r.rating) / sum(n.score), 9) AS prediction
    FROM x_cf_users n JOIN x_ratings r ON r.user_id = n.dst GROUP BY 1, 2) m WHERE {_UNSEEN}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) <= 20
  UNION ALL SELECT 'content', user_id, item_id, score, 0.3::DOUBLE FROM x_content_users
  UNION ALL SELECT 'popularity', user_id, item_id, score, 0.3::DOUBLE FROM x_popular_unseen"""
TABLES["x_ensemble"] = """
  SELECT user_id, item_id, round(sum(s * w), 9) AS score, string_agg(m, ',' ORDER BY m) AS models,
         max(CASE WHEN m = 'content' THEN round(s * w, 9) END) AS content_score,
         row_number() OVER (PARTITION BY user_id ORDER BY round(sum(s * w), 9) DESC, item_id) AS rank
  FROM x_model_lists GROUP BY 1, 2 QUALIFY rank <= 10"""


@stored
def content_lists(t: Inputs) -> DataFrame:
    from wayfunnel.operators.recall import content_for_users
    return content_for_users(pr.content(t), pf.interactions(t), 2 * N).withColumnRenamed("dataset_id", "item_id")


@stored
def popular_lists(t: Inputs) -> DataFrame:
    from wayfunnel.operators.recall import popular_unseen
    return popular_unseen(pf.ratings(t), 2 * N)


def model_lists(t: Inputs) -> dict[str, DataFrame]:
    """Lists of twice the wanted length from one model of each kind."""
    return {"user_cf": cf.user_based(pf.ratings(t), cf_users(t), 2 * N).withColumnRenamed("prediction", "score"),
            "content": content_lists(t), "popularity": popular_lists(t)}


@stored
def ensembled(t: Inputs) -> DataFrame:
    return cf.ensemble(model_lists(t), N)


@query("cf6_weighted_ensemble", f"""
  SELECT user_id, item_id, {R('score')} AS score, models, {R('content_score')} AS content_score, rank FROM x_ensemble""")
def _(t: Inputs) -> DataFrame:
    return ensembled.direct(t).select("user_id", "item_id", "score", F.array_join(F.map_keys("model_scores"), ",").alias("models"),
                                      F.col("model_scores")["content"].alias("content_score"), "rank")


@query("cf8_switched_lists", f"""
  WITH n AS (SELECT user_id, count(*) AS n FROM x_ratings GROUP BY 1),
  k AS (SELECT c.c_custkey AS user_id, CASE WHEN coalesce(n.n, 0) < 5 THEN 'content' ELSE 'collaborative' END AS algorithm
        FROM customer c LEFT JOIN n ON n.user_id = c.c_custkey),
  b AS (SELECT user_id, item_id, score, 'content' AS algorithm FROM x_content_users WHERE rank <= 10
        UNION ALL SELECT user_id, item_id, prediction, 'collaborative' FROM x_user_cf)
  SELECT b.user_id, b.algorithm, b.item_id, {R('b.score')} AS score FROM b JOIN k USING (user_id, algorithm)""")
def _(t: Inputs) -> DataFrame:
    """Content lists for users with fewer than five ratings, collaborative ones for the others."""
    users = t.table("customer").select(F.col("c_custkey").alias("user_id"))
    return cf.switch(pf.ratings(t), users, content_lists(t).filter(F.col("rank") <= N), user_cf(t).withColumnRenamed("prediction", "score"))


def _in_test() -> Column:
    return hash_share("rows", F.concat_ws("-", "user_id", "item_id")) >= 0.8


def rated(t: Inputs) -> DataFrame:
    return pf.ratings(t).select("user_id", "item_id", "rating").filter("rating is not null")


def unfitted_models(t: Inputs) -> dict[str, ev.Model]:
    content_model = ev.similar_content(pr.content(t))
    categories = pf.items(t).filter("create_company_name <> ''").select(F.col("dataset_id").alias("item_id"), F.lower("create_company_name").alias("category"))
    return {"user_based": ev.user_based, "item_based": ev.item_based, "tfidf_content": content_model, "category": ev.same_category(categories),
            "popularity": ev.popularity,
            "hybrid": ev.weighted({"user_cf": ev.user_based, "content": content_model, "popularity": ev.popularity})}


def base_models(t: Inputs) -> dict[str, ev.Model]:
    """The members that a meta model sees."""
    single = {name: model for name, model in unfitted_models(t).items() if name != "hybrid"}
    return single | {"factors": ev.descended(16, 5), "svd": ev.singular(8, 2)}


@query("cf7_meta_model")
def _(t: Inputs) -> DataFrame:
    """Held-out rows predicted by boosted trees over out-of-fold predictions of all base models and rating statistics."""
    models, train, held = base_models(t), written(rated(t).filter(~_in_test()), "meta-train"), rated(t).filter(_in_test())
    guessed = stacking.predict(stacking.fit(models, train), models, train, held)
    return held.join(guessed, ["user_id", "item_id"]).select("user_id", "item_id", "rating", "prediction")


@query("cf7b_meta_lists")
def _(t: Inputs) -> DataFrame:
    """The members' candidates by the meta model's prediction."""
    models, ratings = base_models(t), rated(t)
    lists = [x.select("user_id", "item_id") for x in (*model_lists(t).values(), cf.item_based(ratings, cf_items(t), 2 * N))]
    return stacking.recommend(stacking.fit(models, ratings), models, ratings, reduce(DataFrame.unionByName, lists), N)


_STACK = f"""least(floor({_share('stack', "user_id || '-' || item_id")} * 3), 2)"""
TABLES["x_stack"] = f"SELECT user_id, item_id, rating, CAST({_STACK} AS BIGINT) AS fold FROM x_ratings WHERE rating IS NOT NULL"


@query("cf7c_out_of_fold_features", f"""
  WITH f AS (SELECT * FROM (VALUES (0), (1), (2)) t(k)), r AS (SELECT k AS fold, user_id, item_id, rating FROM x_stack, f WHERE fold <> k),
  u AS (SELECT fold, user_id, avg(rating) AS m, coalesce(stddev_samp(rating), 0) AS d, count(*) AS n FROM r GROUP BY 1, 2),
  i AS (SELECT fold, item_id, avg(rating) AS m, coalesce(stddev_samp(rating), 0) AS d, count(*) AS n, sum(rating) AS s FROM r GROUP BY 1, 2),
  g AS (SELECT dataset_id AS item_id, lower(create_company_name) AS category FROM x_items WHERE create_company_name <> ''),
  c AS (SELECT fold, user_id, category, count(*) AS x FROM r JOIN g USING (item_id) GROUP BY 1, 2, 3)
  SELECT x.fold, x.user_id, x.item_id, {R('x.rating')} AS rating, {R('coalesce(i.s, 0)')} AS popularity,
         {R('coalesce(c.x / CAST(u.n AS DOUBLE), 0)')} AS category, {R('coalesce(u.m, 0)')} AS user_mean, {R('coalesce(u.d, 0)')} AS user_std,
         coalesce(u.n, 0) AS user_count, {R('coalesce(i.m, 0)')} AS item_mean, {R('coalesce(i.d, 0)')} AS item_std, coalesce(i.n, 0) AS item_count
  FROM x_stack x LEFT JOIN u ON u.fold = x.fold AND u.user_id = x.user_id LEFT JOIN i ON i.fold = x.fold AND i.item_id = x.item_id
  LEFT JOIN g ON g.item_id = x.item_id LEFT JOIN c ON c.fold = x.fold AND c.user_id = x.user_id AND c.category = g.category""")
def _(t: Inputs) -> DataFrame:
    """What the meta model learns from, for the base models that SQL can express per fold."""
    models = {name: model for name, model in unfitted_models(t).items() if name in ("popularity", "category")}
    return stacking.out_of_fold(models, rated(t), 3)


@query("cf9_evaluated_models")
def _(t: Inputs) -> DataFrame:
    """One row of held-out errors for each of the nine models of the family."""
    from wayfunnel.operators.recall import hybrid_content_neighbours
    models = {**unfitted_models(t), "hybrid_content": ev.similar_content(hybrid_content_neighbours(pf.items(t), pr.K)),
              "factors": ev.descended(), "svd": ev.singular(8, 3)}
    return ev.errors(ev.predictions(models, rated(t), {0: _in_test()}), "model")


TABLES["x_split"] = f"""
  SELECT user_id, item_id, rating, {_share('rows', "user_id || '-' || item_id")} AS share FROM x_ratings WHERE rating IS NOT NULL"""
TABLES["x_train"] = "SELECT * FROM x_split WHERE share < 0.8"
TABLES["x_train_users"] = _cosine("user_id", "item_id", "x_train")
TABLES["x_train_items"] = _cosine("item_id", "user_id", "x_train")
TABLES["x_unfitted"] = """
  WITH p AS (SELECT user_id, item_id, rating FROM x_split WHERE share >= 0.8),
  z AS (SELECT user_id, count(*) AS size FROM x_train GROUP BY 1),
  g AS (SELECT dataset_id AS item_id, lower(create_company_name) AS category FROM x_items WHERE create_company_name <> ''),
  u AS (SELECT p.user_id, p.item_id, sum(n.score * r.rating) / sum(n.score) AS x FROM p JOIN x_train_users n ON n.src = p.user_id
        JOIN x_train r ON r.user_id = n.dst AND r.item_id = p.item_id GROUP BY 1, 2),
  i AS (SELECT p.user_id, p.item_id, sum(n.score * r.rating) / sum(n.score) AS x FROM p JOIN x_train_items n ON n.src = p.item_id
        JOIN x_train r ON r.item_id = n.dst AND r.user_id = p.user_id GROUP BY 1, 2),
  c AS (SELECT p.user_id, p.item_id, sum(n.score) AS x FROM p JOIN x_content n ON n.dst = p.item_id
        JOIN x_train r ON r.item_id = n.src AND r.user_id = p.user_id GROUP BY 1, 2),
  k AS (SELECT r.user_id, g.category, count(*) AS x FROM x_train r JOIN g USING (item_id) GROUP BY 1, 2),
  o AS (SELECT item_id, sum(rating) AS x FROM x_train GROUP BY 1),
  w AS (SELECT p.*, coalesce(u.x, 0) AS user_based, coalesce(i.x, 0) AS item_based, coalesce(c.x / CAST(size AS DOUBLE), 0) AS tfidf_content,
               coalesce(k.x / CAST(size AS DOUBLE), 0) AS category, coalesce(o.x, 0) AS popularity
        FROM p LEFT JOIN u USING (user_id, item_id) LEFT JOIN i USING (user_id, item_id) LEFT JOIN c USING (user_id, item_id) LEFT JOIN z USING (user_id)
        LEFT JOIN g USING (item_id) LEFT JOIN k ON k.user_id = p.user_id AND k.category = g.category LEFT JOIN o USING (item_id))
  SELECT 'user_based' AS model, rating, user_based AS prediction FROM w UNION ALL SELECT 'item_based', rating, item_based FROM w
  UNION ALL SELECT 'tfidf_content', rating, tfidf_content FROM w UNION ALL SELECT 'category', rating, category FROM w
  UNION ALL SELECT 'popularity', rating, popularity FROM w
  UNION ALL SELECT 'hybrid', rating, 0.4::DOUBLE * user_based + 0.3::DOUBLE * tfidf_content + 0.3::DOUBLE * popularity FROM w"""


def _errors(table: str, keys: str) -> str:
    return f"""
  SELECT {keys}, count(*) AS n, {R('sqrt(avg((rating - prediction) * (rating - prediction)))')} AS rmse, {R('avg(abs(rating - prediction))')} AS mae,
         {R('avg(CASE WHEN rating <> 0 THEN abs((rating - prediction) / rating) END) * 100', 4)} AS mape,
         {R('1 - sum((rating - prediction) * (rating - prediction)) / (var_pop(rating) * count(*))', 4)} AS r2, 1.0::DOUBLE AS coverage
  FROM {table} GROUP BY ALL"""


def _shown(errors: DataFrame) -> DataFrame:
    return errors.withColumns({"mape": F.round("mape", 4), "r2": F.round("r2", 4)})


@query("cf9b_unfitted_models", _errors("x_unfitted", "model"))
def _(t: Inputs) -> DataFrame:
    """The models without fitted factors: the same table and aggregation."""
    return _shown(ev.errors(ev.predictions(unfitted_models(t), rated(t), {0: _in_test()}), "model"))


# -- ranking data -----------------------------------------------------------------

TABLES["x_rank_items"] = f"""
  SELECT s.dataset_id, s.price_log, least(coalesce({DAYS(SQL_AS_OF, 'q.last_event_time')}, 365), 365) AS idle, s.interaction_count,
         {DIV('coalesce(l.click_count, 0)', 'coalesce(l.exposure_count, 0)')} + 0.5 * ({DIV('coalesce(l.conversion_count, 0)', 'coalesce(l.exposure_count, 0)')}) AS target,
         greatest(ln(1 + coalesce(l.exposure_count, 0)), 1) AS sample_weight
  FROM x_static s LEFT JOIN x_stats q USING (dataset_id) LEFT JOIN x_item_labels l USING (dataset_id)"""


@stored
def samples(t: Inputs) -> DataFrame:
    return pfun.samples(t)


@stored
def item_data(t: Inputs) -> DataFrame:
    labels = pfun.fn.item_labels(samples(t), t.conversions)
    return ml.item_ranking_data(prk.static(t), pf.item_stats(t), labels, pf.now())


@query("ml1_item_ranking_data", f"""
  SELECT dataset_id, {R('price_log')} AS price_log, {R('idle')} AS days_since_last_interaction,
         {R('interaction_count / CAST(idle + 1 AS DOUBLE)')} AS interaction_density, {R('target')} AS target,
         {R('sample_weight')} AS sample_weight FROM x_rank_items""")
def _(t: Inputs) -> DataFrame:
    return item_data.direct(t).select("dataset_id", "price_log", "days_since_last_interaction", "interaction_density",
                                      "target", "sample_weight")


@stored
def request_data(t: Inputs) -> DataFrame:
    users = pf.user_features(t).select("user_id", "purchase_count", "total_spent", "recency_score")
    return ml.request_ranking_data(samples(t), prk.static(t), users)


@query("ml2_request_ranking_data", f"""
  SELECT s.request_id, s.dataset_id, CAST(s.label AS BIGINT) AS label, {R('s.score')} AS score, {R('s.position')} AS position,
         {R('coalesce(i.price_log, 0)')} AS price_log, {R('coalesce(u.total_spent, 0)')} AS user_total_spent, s.channel, s.device_type
  FROM x_samples s LEFT JOIN x_static i USING (dataset_id) LEFT JOIN x_user_features u ON u.user_id = s.user_id""")
def _(t: Inputs) -> DataFrame:
    return request_data.direct(t).select("request_id", "dataset_id", "label", "score", "position", "price_log",
                                         "user_total_spent", "channel", "device_type")


@query("ml3_sample_cap", """
  SELECT request_id, dataset_id, CAST(label AS BIGINT) AS label FROM x_samples
  ORDER BY md5(request_id || ':' || dataset_id), request_id, dataset_id LIMIT 1000""")
def _(t: Inputs) -> DataFrame:
    """Hash-ordered sample, the same rows on every run."""
    return ml.sample_cap(samples(t).select("request_id", "dataset_id", "label"), ["request_id", "dataset_id"], 1000)


@query("ml4_group_split", f"SELECT request_id, dataset_id, {_share('split', 'request_id')} < 0.8 AS is_train FROM x_samples")
def _(t: Inputs) -> DataFrame:
    return ml.hash_split(samples(t), "request_id", 0.8).select("request_id", "dataset_id", "is_train")


NUMERIC = ("score", "position", "channel_weight", "price_log", "interaction_count", "popularity_percentile", "slot_mean_ctr",
           "user_purchase_count", "user_total_spent")


@query("ml5_trained_ranker")
def _(t: Inputs) -> DataFrame:
    """NDCG@10 of every trial."""
    data = ml.hash_split(request_data(t), "request_id", 0.8)
    return ml.train_ranker(data, NUMERIC, ("channel", "device_type"), [
        {"maxIter": 5, "maxDepth": 3}, {"maxIter": 10, "maxDepth": 3, "stepSize": 0.05}])[1]


@query("rnk17c_fitted_ranker")
def _(t: Inputs) -> DataFrame:
    """The whole batch job with the fitted ranker in place of the linear one."""
    data = ml.hash_split(request_data(t), "request_id", 0.8)
    model, _ = ml.train_ranker(data, NUMERIC, ("channel", "device_type"), [{"maxIter": 5, "maxDepth": 3}])
    return prk.recommended(t, lambda features: rk.fitted_prediction(features, model, NUMERIC, ("channel", "device_type")))


@query("ml6_trained_scorer")
def _(t: Inputs) -> DataFrame:
    data = ml.hash_split(item_data(t), "dataset_id", 0.75)
    names = ("price_log", "description_length", "tag_count", "weight_log", "slot_mean_ctr")
    model, r2 = ml.train_scorer(data, names, False)
    return ml.importances(model, names, t.spark).withColumn("r2", F.lit(r2))


@query("ml7_scored_items")
def _(t: Inputs) -> DataFrame:
    """Mean score of an item over requests, each scored by a ranker that learned from the other half of the requests."""
    data = written(ml.folds(request_data(t), "request_id", 2), "ranker-rows")
    parts = []
    for k in range(2):
        model, _ = ml.train_ranker(ml.hash_split(data.filter(F.col("fold") != k), "request_id", 0.8), NUMERIC, (), [{"maxIter": 5, "maxDepth": 3}])
        parts.append(model.transform(data.filter(F.col("fold") == k)).select("dataset_id", "prediction"))
    return ml.item_scores(parts[0].unionByName(parts[1]), 50)


@query("ml8_aligned_features", f"""
  SELECT request_id, dataset_id, CAST(label AS BIGINT) AS label, {R('score')} AS score, 0.0::DOUBLE AS brand_new, channel, 'unknown' AS region
  FROM x_samples""")
def _(t: Inputs) -> DataFrame:
    return ml.align(samples(t), [("score", "numeric"), ("brand_new", "numeric"), ("channel", "text"), ("region", "text")])


TABLES["x_truth"] = "SELECT DISTINCT user_id, dataset_id AS item_id FROM x_inter WHERE last_event_time >= TIMESTAMP '2000-01-01'"


@query("ml9_ranking_metrics", f"""
  WITH l AS (SELECT u.user_id, item_id, rank FROM x_ensemble u),
  m AS (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM x_truth t WHERE t.user_id = l.user_id AND t.item_id = l.item_id) THEN 1 ELSE 0 END AS hit FROM l),
  c AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) / CAST(rank AS DOUBLE) AS p FROM m),
  g AS (SELECT user_id, count(*) AS n, sum(hit) AS h, avg(p) AS mean_precision, sum(hit / log2(rank + 1)) AS dcg FROM c GROUP BY 1),
  z AS (SELECT user_id, count(*) AS t FROM x_truth GROUP BY 1),
  q AS (SELECT g.*, t, h / CAST(n AS DOUBLE) AS pr, h / CAST(t AS DOUBLE) AS rc,
               list_sum(list_transform(generate_series(1, least(t, 10)), lambda i: 1 / log2(i + 1))) AS ideal FROM g JOIN z USING (user_id))
  SELECT user_id, {R('pr')} AS precision, {R('rc')} AS recall, {R('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END')} AS f1,
         {R('dcg / ideal')} AS ndcg, {R('mean_precision')} AS mean_precision FROM q""")
def _(t: Inputs) -> DataFrame:
    truth = pf.interactions(t).filter("last_event_time >= timestamp_ntz'2000-01-01 00:00:00'") \
        .select("user_id", F.col("dataset_id").alias("item_id"))
    return ml.ranking_metrics(ensembled(t).select("user_id", "item_id", "rank"), truth, N)


@query("ml10_rating_errors", f"""
  WITH m AS (SELECT item_id, avg(rating) AS prediction FROM x_ratings GROUP BY 1),
  p AS (SELECT rating, prediction FROM x_ratings LEFT JOIN m USING (item_id)),
  b AS (SELECT *, avg(rating) OVER () AS mu FROM p WHERE prediction IS NOT NULL)
  SELECT count(*) AS n, {R('sqrt(avg((rating - prediction) * (rating - prediction)))')} AS rmse, {R('avg(abs(rating - prediction))')} AS mae,
         {R('avg(CASE WHEN rating <> 0 THEN abs((rating - prediction) / rating) END) * 100', 4)} AS mape,
         {R('1 - sum((rating - prediction) * (rating - prediction)) / sum((rating - mu) * (rating - mu))')} AS r2,
         {R('count(*) / CAST((SELECT count(*) FROM p) AS DOUBLE)')} AS coverage FROM b""")
def _(t: Inputs) -> DataFrame:
    ratings = pf.ratings(t)
    means = ratings.groupBy("item_id").agg(F.avg("rating").alias("prediction"))
    return ml.rating_errors(ratings.join(means, "item_id", "left")).withColumn("mape", F.round("mape", 4))


@query("ml11_list_diversity", f"""
  WITH l AS (SELECT u.user_id, u.item_id, v FROM x_ensemble u JOIN x_unit x ON x.dataset_id = u.item_id),
  p AS (SELECT a.user_id, avg(list_dot_product(a.v, b.v)) AS s FROM l a JOIN l b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1)
  SELECT user_id, {R('greatest(0, 1 - s)')} AS diversity FROM p""")
def _(t: Inputs) -> DataFrame:
    return ml.list_diversity(ensembled(t), t.vectors)


@query("ml11b_score_spread", f"""
  SELECT user_id, {R('stddev_pop(prediction)')} AS score_std, {R('least(stddev_pop(prediction) / 5, 1)')} AS unexpectedness FROM x_user_cf GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return ml.score_spread(user_cf(t), "prediction")


@query("ml12_novelty", f"""
  WITH h AS (SELECT item_id FROM x_ratings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100)
  SELECT user_id, {R('avg(CASE WHEN item_id IN (SELECT item_id FROM h) THEN 0.0 ELSE 1.0 END)')} AS novelty FROM x_user_cf GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return ml.novelty(user_cf(t), pf.ratings(t))


@query("ml13_coverage", f"""
  SELECT {R('count(DISTINCT item_id) / CAST((SELECT count(DISTINCT p_partkey) FROM part) AS DOUBLE)')} AS catalogue_coverage,
         {R('count(DISTINCT user_id) / CAST((SELECT count(DISTINCT c_custkey) FROM customer) AS DOUBLE)')} AS user_coverage,
         {R('count(DISTINCT item_id) / CAST(count(*) AS DOUBLE)')} AS unique_ratio FROM x_user_cf""")
def _(t: Inputs) -> DataFrame:
    return ml.coverage(user_cf(t), t.table("part").select(F.col("p_partkey").alias("item_id")),
                       t.table("customer").select(F.col("c_custkey").alias("user_id")))


def _fold(k: int) -> Column:
    return F.least(F.floor(hash_share("fold", F.concat_ws("-", "user_id", "item_id")) * 3), F.lit(2)) == k


@query("ml14_cross_validation")
def _(t: Inputs) -> DataFrame:
    """Errors of the fitted models per fold."""
    models = {"factors": ev.factors(8, 3), "svd": ev.singular(4, 2)}
    return ev.errors(ev.predictions(models, rated(t), {k: _fold(k) for k in range(3)}), "model", "fold")


_FOLD = f"""least(floor({_share('fold', "user_id || '-' || item_id")} * 3), 2)"""
TABLES["x_folds"] = f"""
  WITH r AS (SELECT user_id, item_id, rating, CAST({_FOLD} AS BIGINT) AS fold FROM x_ratings WHERE rating IS NOT NULL),
  f AS (SELECT * FROM (VALUES (0), (1), (2)) t(k)), o AS (SELECT k, item_id, sum(rating) AS s FROM r, f WHERE fold <> k GROUP BY 1, 2)
  SELECT fold, rating, coalesce(s, 0) AS prediction FROM r LEFT JOIN o ON k = fold AND o.item_id = r.item_id"""


@query("ml14b_cross_validated_popularity", _errors("x_folds", "fold"))
def _(t: Inputs) -> DataFrame:
    return _shown(ev.errors(ev.predictions({"popularity": ev.popularity}, rated(t), {k: _fold(k) for k in range(3)}), "fold"))


@query("ml15_recall_hit_rate", f"""
  WITH s AS (SELECT DISTINCT src FROM x_content),
  a AS (SELECT a.dataset_id AS src, b.dataset_id AS dst FROM x_inter a JOIN x_inter b ON a.user_id = b.user_id AND a.dataset_id <> b.dataset_id GROUP BY 1, 2),
  n AS (SELECT src, least(count(*), 50) AS actual FROM a GROUP BY 1),
  h AS (SELECT src, count(*) AS hits FROM x_content JOIN a USING (src, dst) GROUP BY 1)
  SELECT {R('avg(coalesce(hits, 0) / CAST(actual AS DOUBLE))')} AS hit_rate, count(*) AS sources FROM s JOIN n USING (src) LEFT JOIN h USING (src)""")
def _(t: Inputs) -> DataFrame:
    return ml.recall_hit_rate(pr.content(t), pf.interactions(t))


@query("ml16_score_agreement", f"""
  WITH s AS (SELECT dataset_id, round(weight_log, 9) AS a, popularity_percentile AS b FROM x_static),
  r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
               rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM s),
  x AS (SELECT dataset_id FROM s ORDER BY a DESC, dataset_id LIMIT 20), y AS (SELECT dataset_id FROM s ORDER BY b DESC, dataset_id LIMIT 20)
  SELECT {R('corr(ra, rb)')} AS spearman, {R('(SELECT count(*) FROM x JOIN y USING (dataset_id)) / 20.0::DOUBLE')} AS top_overlap FROM r""")
def _(t: Inputs) -> DataFrame:
    data = prk.static(t).select("dataset_id", F.round("weight_log", 9).alias("a"), F.col("popularity_percentile").alias("b"))
    return ml.score_agreement(data, "a", "b")


@query("ml17_interaction_split", f"""
  SELECT {_share('rows', "user_id || '-' || dataset_id")} < 0.8 AS is_train, count(*) AS n FROM x_inter GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    key = F.concat_ws("-", "user_id", "dataset_id")
    return pf.interactions(t).groupBy((hash_share("rows", key) < 0.8).alias("is_train")).agg(F.count(F.lit(1)).alias("n"))
