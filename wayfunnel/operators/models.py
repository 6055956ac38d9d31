"""Ranking data sets, rankers and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.functions.common import days_between, ratio, zero
from wayfunnel.operators.experiments import hash_share
from wayfunnel.operators.ranks import average_ranks
from wayfunnel.operators.relational import top_overall

# Conversion share of the target and the categorical request features.
CVR_WEIGHT = 0.5
CATEGORICAL = ("channel", "endpoint", "variant", "experiment_variant", "source", "device_type", "locale")


def rows() -> Column:
    return F.count(F.lit(1))


def item_ranking_data(static: DataFrame, stats: DataFrame, labels: DataFrame | None, as_of: Column) -> DataFrame:
    """Item features with target CTR + 0.5·CVR and weight max(1, log1p(exposures));
    without labels the target is "was taken"."""
    seen = stats.select("dataset_id", days_between(as_of, "last_event_time").alias("_idle"))
    out = static.drop("days_since_last_interaction", "interaction_density").join(seen, "dataset_id", "left") \
        .withColumn("days_since_last_interaction", F.least(F.coalesce(F.col("_idle").cast("double"), F.lit(365.0)), F.lit(365.0))) \
        .withColumn("interaction_density", F.col("interaction_count") / (F.col("days_since_last_interaction") + 1)).drop("_idle")
    if labels is None:
        return out.withColumns({"target": (F.col("interaction_count") > 0).cast("double"),
                                "sample_weight": F.greatest(F.log1p("interaction_count"), F.lit(1.0))})
    l = labels.select("dataset_id", "click_count", "exposure_count", "conversion_count")
    joined = out.join(l, "dataset_id", "left")
    target = ratio(zero("click_count"), zero("exposure_count")) + CVR_WEIGHT * ratio(zero("conversion_count"), zero("exposure_count"))
    return joined.withColumns({"target": target, "sample_weight": F.greatest(F.log1p(zero("exposure_count")), F.lit(1.0))}) \
        .drop("click_count", "exposure_count", "conversion_count")


def request_ranking_data(samples: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Samples with numeric item features and ``user_`` prefixed user features; gaps are 0 / unknown."""
    def numeric(df: DataFrame, key: str) -> list[str]:
        return [f.name for f in df.schema.fields if f.name != key and isinstance(f.dataType, T.NumericType)]

    item_cols = [c for c in numeric(items, "dataset_id") if c not in samples.columns]
    people = users.select("user_id", *[F.col(c).alias(f"user_{c}") for c in numeric(users, "user_id")])
    joined = samples.filter("request_id is not null and dataset_id is not null") \
        .join(items.select("dataset_id", *item_cols), "dataset_id", "left").join(people, "user_id", "left")
    features = ["score", "position", "channel_weight", *item_cols, *people.columns[1:]]
    out = joined.withColumns({c: zero(c) for c in features})
    out = out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in CATEGORICAL})
    return out.select("request_id", "dataset_id", "label", *sorted(set(features)), *CATEGORICAL)


def sample_cap(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest key hash: the same rows on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", *keys)), *keys).limit(limit)


def hash_split(df: DataFrame, key: str, share: float, salt: str = "split") -> DataFrame:
    """Rows of one key stay together: ``is_train`` by the hash of the key."""
    return df.withColumn("is_train", hash_share(salt, key) < share)


def folds(df: DataFrame, key: str, k: int, salt: str = "fold") -> DataFrame:
    return df.withColumn("fold", F.least(F.floor(hash_share(salt, key) * k), F.lit(k - 1)).cast("int"))


def align(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly the trained columns: absent numbers are 0, absent categories unknown."""
    present = set(df.columns)
    out = []
    for name, kind in columns:
        if kind == "numeric":
            out.append((zero(F.col(name).try_cast("double")) if name in present else F.lit(0.0)).alias(name))
        else:
            out.append((F.coalesce(F.col(name).cast("string"), F.lit("unknown")) if name in present else F.lit("unknown")).alias(name))
    return df.select(*[c for c in ("request_id", "dataset_id", "label", "target", "sample_weight", "is_train", "fold")
                       if c in present and c not in dict(columns)], *out)


def _pipeline(numeric: Sequence[str], categorical: Sequence[str], estimator):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_idx" for c in categorical], handleInvalid="keep"))
    stages += [VectorAssembler(inputCols=[*numeric, *[f"{c}_idx" for c in categorical]], outputCol="raw", handleInvalid="keep"),
               StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True), estimator]
    return Pipeline(stages=stages)


def train_ranker(data: DataFrame, numeric: Sequence[str], categorical: Sequence[str], trials: Sequence[dict], k: int = 10,
                 seed: int = 42):
    """Pointwise boosted trees; the trial with the best NDCG@k on held-out requests is refitted on all rows.

    Returns (model, one row per trial)."""
    from pyspark.ml.regression import GBTRegressor
    train, valid = data.filter("is_train"), data.filter("not is_train")
    results = []
    for i, params in enumerate(trials):
        model = _pipeline(numeric, categorical, GBTRegressor(labelCol="label", seed=seed, **params)).fit(train)
        scored = model.transform(valid).select("request_id", F.col("dataset_id").alias("item"), "label", "prediction")
        value = ndcg(scored, k).agg(zero(F.avg("ndcg")).alias("v")).first()["v"]
        results.append((i, str(sorted(params.items())), float(value)))
    best = max(results, key=lambda r: (r[2], -r[0]))[0]
    model = _pipeline(numeric, categorical, GBTRegressor(labelCol="label", seed=seed, **trials[best])).fit(data)
    return model, data.sparkSession.createDataFrame(results, "trial int, params string, ndcg double")


def train_scorer(data: DataFrame, numeric: Sequence[str], classification: bool, seed: int = 42):
    """Scaled features, weighted boosted trees, AUC or R² on held-out items, refit on all: (model, metric)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor
    kind = GBTClassifier if classification else GBTRegressor
    estimator = kind(labelCol="target", weightCol="sample_weight", maxIter=10, maxDepth=4, seed=seed)
    pipeline = _pipeline(numeric, (), estimator)
    held = pipeline.fit(data.filter("is_train")).transform(data.filter("not is_train"))
    judge = BinaryClassificationEvaluator(labelCol="target") if classification else \
        RegressionEvaluator(labelCol="target", metricName="r2")
    return pipeline.fit(data), float(judge.evaluate(held))


def importances(model, names: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def item_scores(scored: DataFrame, k: int = 50) -> DataFrame:
    means = scored.groupBy("dataset_id").agg(F.avg("prediction").alias("score"))
    return top_overall(means, [F.desc("score"), F.asc("dataset_id")], k)


# -- metrics --------------------------------------------------------------------

def ndcg(scored: DataFrame, k: int) -> DataFrame:
    """NDCG@k per request for (request_id, item, label, prediction)."""
    by_score = Window.partitionBy("request_id").orderBy(F.desc("prediction"), F.asc("item"))
    by_label = Window.partitionBy("request_id").orderBy(F.desc("label"), F.asc("item"))
    ranked = scored.withColumns({"_p": F.row_number().over(by_score), "_i": F.row_number().over(by_label)})

    def gain(r: str) -> Column:
        return F.sum(F.when(F.col(r) <= k, F.col("label") / F.log2(F.col(r) + 1.0)).otherwise(0.0))

    return ranked.groupBy("request_id").agg(gain("_p").alias("_d"), gain("_i").alias("_b")) \
        .select("request_id", ratio("_d", "_b").alias("ndcg"))


def ranking_metrics(recommended: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Precision, recall, F1, NDCG and mean precision@1..k per user.

    ``recommended``: user_id, item_id, rank; ``truth``: user_id, item_id.
    """
    wanted = truth.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    size = wanted.groupBy("user_id").agg(rows().alias("_truth"))
    marked = recommended.filter(F.col("rank") <= k).join(wanted, ["user_id", "item_id"], "left") \
        .withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = marked.withColumn("_precision", F.sum("_hit").over(w) / F.col("rank"))
    per = at.groupBy("user_id").agg(rows().alias("_n"), F.sum("_hit").alias("_h"), F.avg("_precision").alias("mean_precision"),
                                    F.sum(F.col("_hit") / F.log2(F.col("rank") + 1.0)).alias("_dcg")).join(size, "user_id")
    depth = F.least(F.col("_truth"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    p, r = ratio("_h", "_n"), ratio("_h", "_truth")
    return per.select("user_id", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"),
                      (F.col("_dcg") / ideal).alias("ndcg"), "mean_precision")


def rating_errors(pairs: DataFrame, actual: str = "rating", predicted: str = "prediction") -> DataFrame:
    """RMSE, MAE, MAPE (over non-zero ratings), R² and coverage of predicted pairs."""
    both = pairs.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    mean = both.agg(F.avg(actual).alias("m")).scalar()
    total = pairs.agg(rows().alias("n")).scalar()
    e = F.col(actual) - F.col(predicted)
    out = both.withColumn("_m", mean).agg(
        rows().alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        zero(F.avg(F.when(F.col(actual) != 0, F.abs(e / F.col(actual)))) * 100).alias("mape"),
        (1 - F.sum(e * e) / F.nullif(F.sum((F.col(actual) - F.col("_m")) * (F.col(actual) - F.col("_m"))), F.lit(0.0))).alias("r2"))
    return out.withColumn("coverage", ratio("n", total))


def list_diversity(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """1 − mean pairwise cosine per list (floor 0).

    The sum of all pair cosines of unit vectors is (|sum|² − n) / 2, so vectors are summed per
    dimension instead of joining the list with itself.
    """
    from wayfunnel.functions import vectors as vec
    unit = vectors.select(F.col("dataset_id").alias("item_id"), vec.normalised("embedding").alias("v"))
    dims = lists.select("user_id", "item_id").join(unit, "item_id").select("user_id", F.posexplode("v").alias("d", "x"))
    sums = dims.groupBy("user_id", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), rows().alias("n"))
    per = sums.groupBy("user_id").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s2") - F.col("q")) / pairs
    return per.filter("n > 1").select("user_id", F.greatest(F.lit(0.0), 1 - mean).alias("diversity"))


def score_spread(lists: DataFrame, score: str) -> DataFrame:
    return lists.groupBy("user_id").agg(F.stddev_pop(score).alias("score_std"),
                                        F.least(F.stddev_pop(score) / 5, F.lit(1.0)).alias("unexpectedness"))


def novelty(lists: DataFrame, ratings: DataFrame, popular: int = 100) -> DataFrame:
    """Share of a list that is not among the most rated items."""
    counts = ratings.groupBy("item_id").agg(rows().alias("n"))
    head = top_overall(counts, [F.desc("n"), F.asc("item_id")], popular).select("item_id").withColumn("_p", F.lit(1))
    marked = lists.join(F.broadcast(head), "item_id", "left")  # ``popular`` rows
    return marked.groupBy("user_id").agg(F.avg(F.when(F.col("_p").isNull(), 1.0).otherwise(0.0)).alias("novelty"))


def coverage(lists: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    n_items = items.agg(F.count_distinct("item_id").alias("n")).scalar()
    n_users = users.agg(F.count_distinct("user_id").alias("n")).scalar()
    return lists.agg(ratio(F.count_distinct("item_id"), n_items).alias("catalogue_coverage"),
                     ratio(F.count_distinct("user_id"), n_users).alias("user_coverage"),
                     ratio(F.count_distinct("item_id"), rows()).alias("unique_ratio"))


def recall_hit_rate(neighbours: DataFrame, interactions: DataFrame, k: int = 50) -> DataFrame:
    """Share of recommended neighbours that were taken together, over min(co-taken, k), averaged.

    A neighbour pair is a hit when one user took both; only the listed pairs are looked up. The
    number of co-taken items is needed only up to k, which the behaviour top-k supplies exactly.
    """
    from wayfunnel.operators.overlap import shared_feature_topk
    together = shared_feature_topk(interactions, "dataset_id", "user_id", k).groupBy("src").agg(rows().alias("actual"))
    listed = neighbours.filter(F.col("rank") <= k).select("src", "dst")
    taken = interactions.select("user_id", "dataset_id").distinct()
    left = listed.join(taken.withColumnRenamed("dataset_id", "src"), "src")
    hits = left.join(taken.withColumnRenamed("dataset_id", "dst"), ["user_id", "dst"]) \
        .select("src", "dst").distinct().groupBy("src").agg(rows().alias("hits"))
    sources = neighbours.select("src").distinct()
    per = sources.join(together, "src").join(hits, "src", "left").select("src", ratio(zero("hits"), "actual").alias("rate"))
    return per.agg(zero(F.avg("rate")).alias("hit_rate"), rows().alias("sources"))


def score_agreement(scores: DataFrame, score: str, weight: str, k: int = 20) -> DataFrame:
    """Spearman correlation of two columns (average ranks) and overlap of their top k."""
    ranked = average_ranks(average_ranks(scores, score, "_r1"), weight, "_r2")
    a = top_overall(scores, [F.desc(score), F.asc("dataset_id")], k).select("dataset_id")
    b = top_overall(scores, [F.desc(weight), F.asc("dataset_id")], k).select("dataset_id")
    both = a.join(b, "dataset_id", "left_semi").agg(rows().alias("n")).scalar()
    return ranked.agg(zero(F.corr("_r1", "_r2")).alias("spearman")).withColumn("top_overlap", both / F.lit(float(k)))
