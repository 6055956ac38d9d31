"""Neighbours' ratings travel as lists; sums and seen pairs are not shuffled."""

from collections import defaultdict

import numpy as np
import pytest
from test_tiles import shuffled
from wayfunnel.operators import filtering as cf


@pytest.fixture
def wide_joins(spark):
    """Joins as of tables that are too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def lists(rated, near, users):
    """Brute force: the five best unseen items by weighted means, both ways."""
    def best(offers):
        out = set()
        for u, those in offers.items():
            means = sorted((-round(a / b, 9), i) for i, (a, b) in those.items() if (u, i) not in rated)[:5]
            out |= {(u, i, -s, n) for n, (s, i) in enumerate(means, 1)}
        return out

    offers = defaultdict(lambda: defaultdict(lambda: [0.0, 0.0]))
    for src, dst, score in near:
        for (a, b), rating in rated.items():
            if users and a == dst:
                cell = offers[src][b]
            elif not users and b == dst:
                cell = offers[a][src]
            else:
                continue
            cell[0] += score * rating
            cell[1] += score
    return best(offers)


@pytest.mark.parametrize("users", [True, False])
def test_offers_are_not_shuffled(spark, monkeypatch, wide_joins, users):
    monkeypatch.setattr(cf, "LISTED", 32, raising=False)  # a user's ratings make several lists
    r = np.random.default_rng(3)
    rated = {(u, int(i)): round(float(r.uniform(.1, 5)), 3) for u in range(150) for i in r.choice(900, 80, replace=False)}
    near = [(e, int(d), round(float(r.uniform(.1, 1)), 3)) for e in range(150 if users else 900)
            for d in r.choice(150 if users else 900, 10, replace=False) if d != e]
    ratings = spark.createDataFrame([(u, i, x) for (u, i), x in rated.items()], "user_id long, item_id long, rating double").repartition(4).persist()
    found = spark.createDataFrame(near, "src long, dst long, score double").repartition(4).persist()
    ratings.count(), found.count()
    sent, got = shuffled(spark, lambda: (cf.user_based if users else cf.item_based)(ratings, found, 5))
    assert {(x.user_id, x.item_id, x.prediction, x["rank"]) for x in got} == lists(rated, near, users)
    assert sent < 120_000 * 12  # 120,000 cells were offered; a sum of two is 40 bytes


def test_asked_pairs_are_not_multiplied(spark, wide_joins):
    """Pairs meet the neighbours' lists where they are; a pair for each neighbour would be 24 bytes and more."""
    r = np.random.default_rng(6)
    rated = {(u, int(i)): round(float(r.uniform(.1, 5)), 3) for u in range(300) for i in r.choice(400, 40, replace=False)}
    near = {(u, int(d)): round(float(r.uniform(.1, 1)), 3) for u in range(290) for d in r.choice(300, 10, replace=False) if d != u}
    asked = [(u, int(i)) for u in range(300) for i in r.choice(400, 80, replace=False)] + [(7, 3), (7, 3), (7, 1000), (1000, 7), (None, 3), (7, None)]
    ratings = spark.createDataFrame([(*p, x) for p, x in rated.items()], "user_id long, item_id long, rating double").repartition(4).persist()
    found = spark.createDataFrame([(*p, x) for p, x in near.items()], "src long, dst long, score double").repartition(4).persist()
    pairs = spark.createDataFrame(asked, "user_id long, item_id long").repartition(4).persist()
    ratings.count(), found.count(), pairs.count()
    others = defaultdict(list)
    for (u, d), score in near.items():
        others[u].append((d, score))
    want = []
    for u, i in asked:
        cells = [(score, rated[d, i]) for d, score in others[u] if (d, i) in rated]
        guess = sum(a * b for a, b in cells) / sum(a for a, _ in cells) if cells else 0.0
        want.append((str(u), str(i), round(rated.get((u, i), guess), 6)))
    sent, got = shuffled(spark, lambda: cf.predict(pairs, ratings, found))
    assert sorted((str(x.user_id), str(x.item_id), round(x.prediction, 6)) for x in got) == sorted(want)
    assert sent < 2_200_000  # 2,914,137 with a row for each pair and neighbour


def test_products_are_not_shuffled(spark, wide_joins):
    r = np.random.default_rng(8)
    cells = [(u, int(i), round(float(r.uniform(.1, 5)), 3)) for u in range(1500) for i in r.choice(5000, 40, replace=False)]
    ratings = spark.createDataFrame(cells, "user_id long, item_id long, rating double").repartition(4).persist()
    ratings.count()
    sent, got = shuffled(spark, lambda: cf.cosine_neighbours(ratings, "user_id", "item_id", 5))
    m = np.zeros((1500, 5000))
    for u, i, x in cells:
        m[u, i] = x
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, 0)
    want = {(u, v): n for u in range(1500) for n, v in enumerate(np.lexsort((np.arange(1500), -s[u]))[:5].tolist(), 1)}
    assert {(x.src, x.dst): x["rank"] for x in got} == want
    assert max(abs(x.score - s[x.src, x.dst]) for x in got) < 2e-9
    assert sent < 480_000 * 32  # so many pairs meet, nearly all of them once
