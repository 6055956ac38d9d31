import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from wayfunnel.llm import toxicity

BAD = ["vilespeak", "grumblord", "nastifoo"]


def corpus(n=600):
    r = random.Random(2)
    common = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(3, len(words) // 15)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9001, None, 0.5), (9002, "", 0.5), (None, "x", 0.5)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9003, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out and i is not None and i < 9000} == {i for i, _ in held}
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[9001].score == got[9002].score < 0.5
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.classify(docs, none).collect()] == [0, 0]
    assert toxicity.classify(docs.filter(F.lit(False)), none).count() == 0


def test_separable_rows_stay_bounded():
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), r.normal(size=400), np.r_[np.zeros(200), np.full(200, 9.0)], np.zeros(400)])
    y = np.r_[np.zeros(200), np.ones(200)]
    w = np.array(toxicity._logistic(x, y))
    assert np.abs(w).max() < 50 and ((x @ w > 0) == y).all()
