import numpy as np

from wayfunnel.llm import impact


def brute(rows, asked, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v):
            v = [int(np.floor(64 * x)) for x in v]
            best[i] = min(best.get(i, v), v)
    ids, vectors = np.array(sorted(best)), np.array([best[i] for i in sorted(best)])
    out = set()
    for q in asked & set(best):
        scores = vectors @ np.array(best[q])
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out |= {(q, r, int(ids[j]), int(scores[j])) for r, j in enumerate(order, 1)}
    return out


def found(table, queries, k=20):
    return {tuple(x) for x in impact.search(table, queries, k).select("query_id", "rank", "vec_id", "score").collect()}


def test_exact_with_ties_copies_and_odd_rows(spark, monkeypatch):
    r = np.random.default_rng(5)
    vectors = [[float(x) for x in np.float32(v * s)] for v, s in zip(r.normal(size=(1500, 8)), r.uniform(.1, .4, 1500), strict=True)]
    rows = list(enumerate(vectors))
    rows += [(i, [round(x) * .1 for x in r.normal(size=8)]) for i in range(1500, 1800)]  # many equal scores
    rows += [(2000 + i, vectors[3]) for i in range(90)]  # copies
    rows += [(3000, None), (3020, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [1.0, None] * 4), (3004, [float("inf")] * 8), (3005, [1.0]),
             (None, vectors[0]), (20, vectors[8]), (3006, []), (3040, [300.5] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, score int, block int, query_id int")
    queries = table.filter("vec_id % 20 = 0")
    expected = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert found(table, queries) == expected
    monkeypatch.setattr(impact, "BLOCK", 200)  # many blocks, and scores to reach from the first
    monkeypatch.setattr(impact, "QUERIES", 16)
    assert found(table, queries) == expected


def test_reading_stops_before_the_end():
    r = np.random.default_rng(6)
    centre = r.normal(size=64) * 8
    vectors = np.floor(np.concatenate([r.normal(size=(4000, 64)) * 8, centre + r.normal(size=(60, 64))])).astype(np.int64)
    index = impact.Index(vectors)
    for query in (vectors[4010], vectors[5]):
        exact = vectors @ query
        at, scores, read = index.search(query, 20)
        least = np.sort(exact)[-20]
        assert set(np.flatnonzero(exact >= least)) <= set(at.tolist()) and (scores == exact[at]).all()
        assert read < .8 * vectors.size
    assert impact.Index(vectors).search(vectors[4010], 20)[2] < .5 * index.search(vectors[5], 20)[2]  # near vectors end it early
    assert len(index.search(vectors[5], 20, 10 ** 6)[0]) == 0


def test_large_components():
    vectors = np.array([[1 << 24, 1], [-(1 << 24), 1], [3, -(1 << 24)], [0, 0]])
    for query in vectors:
        at, scores, _ = impact.Index(vectors).search(query, 4)
        assert dict(zip(at.tolist(), scores.tolist())) == dict(enumerate((vectors @ query).tolist()))


def test_few_rows(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert found(table, table.filter("vec_id % 20 = 0")) == {(20, 1, 2, 4096), (20, 2, 1, 2048)}
    assert found(table, table, 1) == {(20, 1, 2, 4096), (2, 1, 20, 4096), (1, 1, 2, 2048)}
    assert found(table.limit(0), table) == set()
    assert found(table, table.limit(0)) == set()
