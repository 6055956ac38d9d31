import numpy as np

from wayfunnel.llm import permutation


def brute(rows, queries, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, list(v)), list(v))
    ids = np.array(sorted(best))
    vectors = np.array([best[i] for i in ids])
    out = {}
    for q in queries:
        if q in best:
            scores = vectors @ np.array(best[q])
            out[q] = [(int(ids[j]), float(scores[j])) for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
    return out


def test_recall_ties_and_odd_rows(spark):
    r = np.random.default_rng(7)
    vectors = [[float(x) for x in np.float32(v * s)] for v, s in zip(r.normal(size=(1500, 8)), r.uniform(.5, 2, 1500), strict=True)]
    rows = list(enumerate(vectors))
    rows += [(2000 + i, vectors[3]) for i in range(60)]  # copies
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [1.0, None] * 4), (3004, [float("inf")] * 8), (3005, [1.0]),
             (None, vectors[0]), (7, vectors[8])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    queries = table.filter("vec_id % 20 = 0 or vec_id > 2990")
    got = {}
    for x in permutation.neighbours(table, queries, 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    expected = brute(rows, [i for i, _ in rows if i is not None and (i % 20 == 0 or i > 2990)], 20)
    assert set(got) == set(expected)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) == 20
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {i for i, _ in expected[q]})
        exact = dict(brute(rows, [q], 5000)[q])
        assert all(abs(exact[f[1]] - f[2]) < 1e-9 for f in found)
    assert hits >= 0.95 * 20 * len(expected)
    assert [i for _, i, _ in got[2000]] == [i for i, _ in expected[2000]]  # among copies ties go to the smaller id


def test_few_rows(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in permutation.neighbours(table, table.filter("vec_id % 20 = 0")).collect())
    assert got == [(20, 1, 2, 1.0), (20, 2, 1, 0.5)]
    assert permutation.neighbours(table.limit(0), table).count() == 0
    assert permutation.neighbours(table, table.limit(0)).count() == 0
