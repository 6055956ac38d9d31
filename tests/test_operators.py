"""Hand-computed values on tiny tables, and brute force against the split algorithms."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfunnel.functions import events as ev
from wayfunnel.functions import text as tx
from wayfunnel.operators import attribution as at
from wayfunnel.operators import experiments as ex
from wayfunnel.operators import filtering as cf
from wayfunnel.operators import funnel as fn
from wayfunnel.operators import nearest as nn
from wayfunnel.operators import overlap as ov
from wayfunnel.operators import ranking as rk
from wayfunnel.operators import ranks
from wayfunnel.operators import recall as rc
from wayfunnel.sources import readers as rd
from wayfunnel.sinks import writers as wr


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def inter(spark):
    return spark.createDataFrame([(1, 101), (1, 102), (2, 101), (2, 103), (3, 104), (3, 102)], "user_id long, dataset_id long")


def test_slot_metrics(spark):
    e = spark.createDataFrame([(1, 1, "req_a"), (1, 2, "req_b"), (2, 1, "req_c")], "dataset_id long, position int, request_id string")
    c = spark.createDataFrame([(1, 1, "req_a"), (1, None, "req_b")], "dataset_id long, position int, request_id string")
    v = spark.createDataFrame([(1, 1, "req_a", 10.0)], "dataset_id long, position int, request_id string, revenue double")
    got = rows(fn.slot_metrics(e, c, v), "dataset_id", "position", "exposure_count", "click_count", "conversion_count", "conversion_revenue")
    assert got == [(1, 1, 1, 1, 1, 10.0), (1, 2, 1, 1, 0, 0.0), (2, 1, 1, 0, 0, 0.0)]


def test_variant_metrics_defaults(spark):
    e = spark.createDataFrame([("req_a", 1, "primary", "detail", None, None), ("req_b", 1, "shadow", "detail", None, None)],
                              "request_id string, dataset_id long, variant string, endpoint string, page_id string, algorithm_version string")
    c = spark.createDataFrame([("req_a", 1)], "request_id string, dataset_id long")
    got = rows(fn.variant_metrics(e, c, c.limit(0)), "variant", "page_id", "algorithm_version", "exposure_count", "click_count")
    assert got == [("primary", "", "unknown", 1, 1), ("shadow", "", "unknown", 1, 0)]


def test_behaviour_neighbours_hand_values(inter):
    got = {(r.src, r.dst): r.score for r in rc.behaviour_neighbours(inter, 10).collect()}
    assert got == {(101, 102): .5, (101, 103): .5, (102, 101): .5, (102, 104): .5, (103, 101): 1.0, (104, 102): 1.0}


@pytest.mark.parametrize("heavy", [0, 3, 8, 1000])
@pytest.mark.parametrize("measure", ["count", "jaccard"])
def test_shared_features_match_brute_force(spark, heavy, measure):
    rng = random.Random(heavy)
    data = {(e, f) for e in range(30) for f in range(12) if rng.random() < (0.9 if f == 0 else 0.25)}
    sets = {}
    for e, f in data:
        sets.setdefault(e, set()).add(f)
    want = []
    for a in sets:
        scored = []
        for b in sets:
            common = len(sets[a] & sets[b])
            if a != b and common >= 2:
                scored.append((-(common if measure == "count" else common / len(sets[a] | sets[b])), b))
        want += [(a, b, round(-s, 9)) for s, b in sorted(scored)[:4]]
    df = spark.createDataFrame(list(data), "e long, f long")
    score = ov.overlap_count if measure == "count" else ov.jaccard
    got = [(r.src, r.dst, round(r.score, 9)) for r in ov.shared_feature_topk(df, "e", "f", 4, score, 2, heavy).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    m[40:] = m[0]  # a third are copies of one vector
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, val array<double>")
    got = rows(nn.nearest(points, 3, min_score=0.1, block_rows=block_rows), "src", "rank", "dst")
    want = []
    for i in range(60):
        s = np.round(m @ m[i], 9)
        best = sorted((-s[j], j) for j in range(60) if j != i and s[j] >= 0.1)[:3]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("heavy", [2, 1000])
def test_cosine_neighbours_blocked_and_joined_agree(spark, heavy):
    rng = random.Random(5)
    data = [(u, i, rng.uniform(1, 5)) for u in range(20) for i in range(10) if rng.random() < 0.4]
    df = spark.createDataFrame(data, "user_id long, item_id long, rating double")
    vectors = {}
    for u, i, r in data:
        vectors.setdefault(u, np.zeros(10))[i] = r
    want = []
    for a, va in vectors.items():
        s = sorted((-round(float(va @ vb / np.linalg.norm(va) / np.linalg.norm(vb)), 9), b) for b, vb in vectors.items() if b != a)
        want += [(a, b, -x) for x, b in s[:3] if x < 0]
    got = rows(cf.cosine_neighbours(df, "user_id", "item_id", 3, heavy=heavy, block=6), "src", "dst", "score")
    assert got == sorted(want)


def test_same_group_skips_self(spark):
    df = spark.createDataFrame([(i, "a") for i in range(1, 6)] + [(9, "b")], "id long, g string")
    assert rows(ov.same_group_topk(df, "id", F.col("g"), 2), "src", "dst") == [
        (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)]


def test_ranks_quantiles_concentration(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 3, 8, 8, 8, 2)], "x double")
    q = ranks.quantiles(df, "x", {"q1": 0.25, "q2": 0.5}).first()
    assert (q.q1, q.q2) == (np.quantile([5, 1, 1, 3, 8, 8, 8, 2], .25), 4.0)
    dense = {(r.x, r.r) for r in ranks.with_dense_rank(df, "x", "r").collect()}
    assert dense == {(8.0, 1), (5.0, 2), (3.0, 3), (2.0, 4), (1.0, 5)}
    c = ranks.concentration(spark.createDataFrame([(2.0,)] * 4, "x double"), "x").first()
    assert math.isclose(c.as_written, 0.75) and abs(c.gini) < 1e-12


def test_as_of_within_and_across_days(spark):
    e = spark.createDataFrame([(1, 7, "2024-01-03 10:00:00"), (2, 7, "2024-01-01 09:00:00"), (3, 8, "2024-01-02 00:00:00")],
                              "id long, k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    s = spark.createDataFrame([(10, 7, "2024-01-01 09:00:00", "a"), (11, 7, "2024-01-02 23:00:00", "b"), (12, 7, "2024-01-03 10:00:01", "c")],
                              "sid long, k long, t string, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert rows(at.as_of_last(e, s, "k", "t", "sid", ["v"]), "id", "state_v")[:2] == [(1, "b"), (2, "a")]


def test_event_expressions(spark):
    df = spark.createDataFrame([("https://x/dataDetail/42?from=recommend&rid=req_abc&pos=3", "click_2_42", "req_abc", "fallback_x+tag"),
                                ("https://x/payment/9", "xclick_2_1", "3", "")], "url string, custom_dimension_5 string, d string, reason string")
    got = df.select(ev.item_from_text("url"), ev.click_slot(), ev.digits_only("d"), ev.channel_first("reason")).collect()
    assert [tuple(r) for r in got] == [(42, 2, None, "fallback"), (9, None, 3, "unknown")]
    assert ev.request_columns("7,x") == [f"custom_dimension_{i}" for i in (7, 4, 2, 3, 1)]


def test_new_allocations(spark):
    totals = spark.createDataFrame([("control", 1000, 50), ("test", 1000, 80)], "variant string, exposure_count long, click_count long")
    variants = spark.createDataFrame([("control", .5), ("test", .5)], "variant string, allocation double")
    got = {r.variant: round(r.new_allocation, 6) for r in ex.new_allocations(totals, variants, 10, 1.0, 20.0, 0.1).collect()}
    assert got == {"control": 0.397727, "test": 0.602273}
    none = ex.new_allocations(totals, variants, 10_000, 1.0, 20.0, 0.1)
    assert {r.new_allocation for r in none.collect()} == {0.5}


def test_mmr_lambda_and_freshness(spark):
    cases = [(None, None, .5), ("search", None, .6), ("landing", None, .3), (None, "mobile", .4), ("landing", "mobile", .2)]
    df = spark.createDataFrame([("recommend_detail", s, d) for s, d, _ in cases], "e string, s string, d string")
    assert [r[0] for r in df.select(rk.mmr_lambda("e", "s", "d")).collect()] == [c[2] for c in cases]
    days = spark.createDataFrame([(d,) for d in (3, 7, 15, 30, 60, None)], "d int")
    assert [r[0] for r in days.select(tx.freshness("d")).collect()] == [1.0, 1.0, .5, .5, .2, .2]


def test_mmr_matches_greedy(spark):
    scores = {1: 1.0, 2: .9, 3: .5, 4: .1}
    tags = {1: "a;b", 2: "a;b", 3: "c", 4: "a"}
    items = spark.createDataFrame(list(tags.items()), "dataset_id long, tag string")
    cand = spark.createDataFrame([(1, i, s, "x", .5) for i, s in scores.items()],
                                 "request_id long, item long, score double, reason string, mmr_lambda double")
    got = [r.item for r in rk.diversify(cand, items, 3).orderBy("rank").collect()]
    norm = {i: (s - .1) / .9 for i, s in scores.items()}
    sets = {i: set(t.split(";")) for i, t in tags.items()}
    picked = []
    while len(picked) < 3:
        rest = [i for i in scores if i not in picked]
        picked.append(max(rest, key=lambda i: (round(.5 * norm[i] - .5 * max(
            (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in picked), default=0.0), 9), -i)))
    assert got == picked


def test_exploration_keeps_length(spark):
    ranked = spark.createDataFrame([(1, i, 1.0, "x", i) for i in range(1, 11)], "request_id long, item long, score double, reason string, rank int")
    items = spark.createDataFrame([(i,) for i in range(1, 3000)], "dataset_id long")
    out = rk.explore(ranked, items, 0.2, 10).collect()
    assert len({r.item for r in out}) == 10 and sum(r.reason == "exploration" for r in out) == 2


def test_exposure_log_rules(spark):
    good = {"request_id": "req_1", "timestamp": "2024-01-01T00:00:00", "items": [{"dataset_id": 5, "score": 1}, {"dataset_id": "x"}, {"dataset_id": "7", "score": "bad"}]}
    lines = ["", "{bad", json.dumps({"items": []}), json.dumps({**good, "request_id": "a1"}), json.dumps(good), json.dumps({"request_id": "req_2", "items": None})]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(rd.parse_exposures(df), "request_id", "dataset_id", "position", "score") == [("req_1", 5, 0, 1.0), ("req_1", 7, 2, None)]
    assert rd.parse_exposures(df, require_prefix=False).count() == 4


def test_json_increments_and_upsert(spark, tmp_path):
    for name, ident in (("task.json", 1), ("task_20240101_000000.json", 2), ("task_20240301_000000.json", 3), ("taskother.json", 9)):
        (tmp_path / name).write_text(json.dumps([{"id": ident, "price": "2.5" if ident < 3 else "bad"}]))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.StringType())])
    assert rows(rd.json_table(spark, str(tmp_path), "task", schema), "id") == [(1,), (2,), (3,)]
    later = rd.json_table(spark, str(tmp_path), "task", schema, "2024-02-01 00:00:00").collect()
    assert [(r.id, r.price) for r in later] == [(3, None)]
    target = str(tmp_path / "table")
    for n, data in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        wr.upsert(spark.createDataFrame(data, "id long, v string").withColumn("load_seq", F.lit(n)), target, ["id"])
    assert rows(wr.current_version(spark, target), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_popular_unseen_matches_brute_force(spark):
    rng = random.Random(1)
    data = [(u, i, float(rng.randint(1, 5))) for u, i in itertools.product(range(6), range(15)) if rng.random() < 0.5]
    df = spark.createDataFrame(data, "user_id long, item_id long, rating double")
    total = {}
    for _, i, r in data:
        total[i] = total.get(i, 0) + r
    want = []
    for u in {u for u, _, _ in data}:
        seen = {i for v, i, _ in data if v == u}
        best = sorted((i for i in total if i not in seen), key=lambda i: (-round(total[i], 9), i))[:3]
        want += [(u, i) for i in best]
    assert rows(rc.popular_unseen(df, 3), "user_id", "item_id") == sorted(want)


def test_truncated_svd_reproduces_low_rank(spark):
    rng = np.random.default_rng(0)
    a = np.abs(rng.normal(size=(12, 2)) @ rng.normal(size=(2, 9)))
    a = np.outer(np.arange(1, 13), np.arange(1, 10)) / 30.0
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(9)], "user_id long, item_id long, rating double")
    users, items = cf.truncated_svd(df, rank=2, rounds=2)
    for r in cf.factor_scores(df.select("user_id", "item_id"), users, items).collect():
        assert abs(r.prediction - min(5.0, a[r.user_id, r.item_id])) < 1e-6
