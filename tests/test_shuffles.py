"""Lists and vectors travel whole: what is shuffled doesn't follow the rows that they are taken apart into."""

from collections import defaultdict

import numpy as np
import pytest
from test_tiles import shuffled
from wayfunnel.operators import features as ft
from wayfunnel.operators import nearest as nn
from wayfunnel.operators import recall as rc


@pytest.fixture
def wide_joins(spark):
    """Joins as of tables that are too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_offered_items_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(rc, "LIST_ROWS", 16, raising=False)
    r = np.random.default_rng(4)
    taken = {u: r.choice(4000, 100, replace=False).tolist() for u in range(300)}
    near = {u: [(int(v), round(float(x), 3)) for v, x in zip(r.choice(300, 20, replace=False), r.uniform(.1, 1, 20)) if v != u] for u in range(300)}
    inter = spark.createDataFrame([(u, i) for u, own in taken.items() for i in own], "user_id long, dataset_id long").repartition(4).persist()
    found = spark.createDataFrame([(u, v, x) for u, those in near.items() for v, x in those], "src long, dst long, score double").repartition(4).persist()
    inter.count(), found.count()
    sent, got = shuffled(spark, lambda: rc.user_candidates(found, inter, 5))
    want = set()
    for u, those in near.items():
        sums = defaultdict(float)
        for v, x in those:
            for i in taken[v]:
                sums[i] += x
        best = sorted((-round(s, 9), i) for i, s in sums.items() if i not in taken[u])[:5]
        want |= {(u, i, -s, n) for n, (s, i) in enumerate(best, 1)}
    assert {(x.user_id, x.dataset_id, x.score, x["rank"]) for x in got} == want
    assert sent < 300 * 20 * 100 * 8  # 600,000 rows were offered


def test_audience_tells_pairs_apart_without_features(spark):
    r = np.random.default_rng(5)
    pairs = [(int(u), int(i)) for u, i in zip(r.integers(0, 2000, 60000), r.integers(0, 50, 60000))] + [(None, 3), (5, None)]
    inter = spark.createDataFrame(pairs, "user_id long, dataset_id long").repartition(4).persist()
    people = spark.createDataFrame([(u, *r.uniform(0, 1, 10).tolist()) for u in range(1900)],
                                   "user_id long, " + ", ".join(f"{c} double" for c in list(ft.AUDIENCE)[1:])).persist()
    inter.count(), people.count()
    sent, got = shuffled(spark, lambda: ft.audience_stats(inter, people))
    distinct = defaultdict(set)
    for u, i in pairs:
        distinct[i] |= {u} - {None}
    assert {x.dataset_id: x.user_unique_buyers for x in got} == {i: len(u) for i, u in distinct.items()}
    known = {x.user_id: x.recency_score for x in people.collect()}
    mean = np.mean([known[u] for u, i in pairs if i == 7 and u in known])
    assert abs(next(x.user_recency_score_mean for x in got if x.dataset_id == 7) - mean) < 1e-9
    assert sent < 60000 * 40  # ten means of 16 bytes stood beside each pair


def test_pooled_vectors_are_not_shuffled_by_place(spark, wide_joins):
    r = np.random.default_rng(6)
    m = r.normal(size=(2000, 64)).astype(np.float32).astype(float)
    vectors = [(i, x.tolist()) for i, x in enumerate(m)] + [(2000, [1.0, None]), (2001, [3.0]), (2002, []), (2003, None)]
    shown = [(d, p, d * 8 + p, int(r.integers(0, 2000))) for d in range(3000) for p in range(5)]
    shown += [(9001, 0, 1, 2000), (9001, 1, 2, 2001), (9001, 2, 3, 2002), (9002, 0, 4, 2002), (9003, 0, 5, 2003)]
    images = spark.createDataFrame(shown, "dataset_id long, image_order long, image_key long, vec_id long").repartition(4).persist()
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").persist()
    images.count(), table.count()
    sent, got = shuffled(spark, lambda: ft.mean_pool(images, table))
    rows = {x.dataset_id: x for x in got}
    assert len(rows) == 3001 and rows[9001].image_embed_mean == [2.0, None]
    for d in (0, 17, 2999):
        want = m[[v for e, p, _, v in shown if e == d and p < 4]].mean(axis=0)
        assert np.allclose(rows[d].image_embed_mean, want) and abs(rows[d].image_embed_norm - np.linalg.norm(want)) < 1e-9
    assert sent < 3000 * 4 * 64 * 4 * 1.7  # four vectors an item


def test_members_are_sent_to_the_queries_of_their_tile(spark, monkeypatch):
    monkeypatch.setattr(nn, "TILE_ROWS", 100)
    m = np.random.default_rng(8).uniform(0, 100, 3000)
    points = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate(m)], "id long, val array<double>").repartition(4).persist()
    points.count()
    sent, got = shuffled(spark, lambda: nn.nearest(points, 3, "cityblock", block_rows=40))
    s = np.round(1 / (1 + np.abs(m[:, None] - m[None, :])), 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j), n) for i in range(3000) for n, j in enumerate(np.lexsort((np.arange(3000), -s[i]))[:3], 1)}
    assert {(x.src, x.dst, x["rank"]) for x in got} == want
    assert sent < 3000 * 30 * 18  # each member was sent to 30 lines
