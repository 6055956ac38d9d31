"""The long table of predictions against plain Python."""

import math

from pyspark.sql import functions as F

from wayfunnel.operators import evaluation as ev
from wayfunnel.operators import filtering as cf

RATINGS = [(u, i, float((u * 7 + i * 3) % 5 + 1)) for u in range(12) for i in range(9) if (u * 5 + i) % 4]


def test_errors_of_two_models_and_folds(spark):
    ratings = spark.createDataFrame(RATINGS, "user_id long, item_id long, rating double")
    models: dict[str, ev.Model] = {"popularity": ev.popularity,
                               "some": lambda train, pairs: pairs.filter("item_id < 5").withColumn("prediction", F.lit(3.0))}
    folds = {k: (F.col("user_id") + F.col("item_id")) % 2 == k for k in (0, 1)}
    got = {(r.model, r.fold): r for r in ev.errors(ev.predictions(models, ratings, folds), "model", "fold").collect()}
    assert len(got) == 4
    for fold in (0, 1):
        train = [x for x in RATINGS if (x[0] + x[1]) % 2 != fold]
        held = [x for x in RATINGS if (x[0] + x[1]) % 2 == fold]
        pairs = [(r, sum(y for _, j, y in train if j == i)) for _, i, r in held]
        row, mean = got["popularity", fold], sum(r for r, _ in pairs) / len(pairs)
        squares = sum((r - p) ** 2 for r, p in pairs)
        assert row.n == len(pairs) and row.coverage == 1.0
        assert math.isclose(row.rmse, math.sqrt(squares / len(pairs))) and math.isclose(row.mae, sum(abs(r - p) for r, p in pairs) / len(pairs))
        assert math.isclose(row.r2, 1 - squares / sum((r - mean) ** 2 for r, _ in pairs))
        known = [r for _, i, r in held if i < 5]
        assert got["some", fold].n == len(known) and math.isclose(got["some", fold].coverage, len(known) / len(held))


def test_item_based_prediction_of_pairs(spark):
    ratings = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)], "user_id long, item_id long, rating double")
    near = spark.createDataFrame([(3, 1, .5), (3, 2, .25), (4, 9, 1.0)], "src long, dst long, score double")
    pairs = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (1, 1)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): r.prediction for r in cf.predict_by_items(pairs, ratings, near).collect()}
    assert got == {(1, 3): (4 * .5 + 2 * .25) / .75, (2, 3): 5.0, (1, 4): 0.0, (1, 1): 4.0}
