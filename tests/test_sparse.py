"""Sparse neighbours against brute force, and how much their bounds leave to read."""

import numpy as np
import pytest

from wayfunnel.operators import sparse as sp


def rows_of(m):
    return [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for i, r in enumerate(m)]


def brute(m, q, k, least, strict=False, own=True):
    out = set()
    for i, v in enumerate(q):
        s = np.round(m @ v, 9)
        best = sorted((-s[j], j) for j in range(len(m)) if (not own or j != i) and (s[j] > least if strict else s[j] >= least))[:k]
        out |= {(i, j, r) for r, (_, j) in enumerate(best, 1)}
    return out


def found(df):
    return {(r.src, r.dst, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    """Rows with a term that a third of all hold, copies, empty rows, negative and long ones."""
    r = np.random.default_rng(4)
    m = np.zeros((300, 60))
    for i in range(300):
        terms = np.unique(np.minimum(59, r.zipf(1.4, r.integers(1, 20))))
        m[i, terms] = r.uniform(.1, 1, len(terms))
    m[:100, 0] = 2.0
    m[200:240] = m[200]  # copies
    m[250:253] = 0.0
    m[260, 5] = -1.5
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, lengths, out=m, where=lengths > 0)
    m[270] *= 3
    return m


@pytest.mark.parametrize("block", [16, 5000])
def test_matches_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(sp, "TILE", 32)
    points = spark.createDataFrame(rows_of(texts), "id long, idx array<int>, val array<double>")
    assert found(sp.sparse_topk(points, 5, .05, block=block)) == brute(texts, texts, 5, .05)
    assert found(sp.sparse_topk(points, 3, block=block)) == brute(texts, texts, 3, -np.inf)
    asked = texts[::7] * .5
    queries = spark.createDataFrame(rows_of(asked), "id long, idx array<int>, val array<double>")
    got = found(sp.sparse_topk(points, 4, 0.0, True, queries, exclude_self=False, block=block))
    assert got == brute(texts, asked, 4, 0.0, True, own=False)


def test_empty_tables(spark, texts):
    points = spark.createDataFrame(rows_of(texts[:5]), "id long, idx array<int>, val array<double>")
    assert sp.sparse_topk(points.limit(0), 3).count() == 0
    assert sp.sparse_topk(points, 3, queries=points.limit(0)).count() == 0


def test_visits_are_shuffled_whatever_their_file_holds(spark, texts, monkeypatch):
    """The table of visits is tiny as a file and has a row for each query and block: no join may bring it to the driver."""
    joined = []
    search = sp._tile_search
    monkeypatch.setattr(sp, "_tile_search", lambda asked, *rest: joined.append(asked) or search(asked, *rest))
    points = spark.createDataFrame(rows_of(texts[:120]), "id long, idx array<int>, val array<double>")
    assert found(sp.sparse_topk(points, 5, .05, block=16)) == brute(texts[:120], texts[:120], 5, .05)
    assert len(joined) == 2  # the own blocks, and the others
    plan = joined[1]._jdf.queryExecution().executedPlan().toString()
    assert "sparse-visits" in plan and "SortMergeJoin" in plan
    visits = plan[:plan.index("sparse-visits")].splitlines()
    assert not any("BroadcastExchange" in line for line in visits[-3:])


def test_blocks_are_indexed_in_parts(spark, texts, monkeypatch):
    """Parts of a few rows leave the same lists, ties included."""
    monkeypatch.setattr(sp, "SLICE", 40)
    points = spark.createDataFrame(rows_of(texts), "id long, idx array<int>, val array<double>")
    assert found(sp.sparse_topk(points, 5, .05)) == brute(texts, texts, 5, .05)
    assert found(sp.sparse_topk(points, 3)) == brute(texts, texts, 3, -np.inf)
    sets = spark.createDataFrame([(i, sorted({i % 7, i % 11 + 7, i % 13 + 18})) for i in range(200)], "id long, idx array<int>") \
        .selectExpr("id", "idx", "transform(idx, x -> 1D) val", "size(idx) size")
    lists = [set(r.idx) for r in sets.orderBy("id").collect()]
    want = set()
    for i, a in enumerate(lists):
        best = sorted((-round(len(a & b) / len(a | b), 9), j) for j, b in enumerate(lists) if j != i and a & b)[:4]
        want |= {(i, j, r) for r, (_, j) in enumerate(best, 1)}
    assert found(sp.sparse_topk(sets, 4, 0.0, common=1.0)) == want


def test_bounds_spare_frequent_terms():
    """With a high score to beat only rare terms' lists are opened, and the rows met there are finished."""
    r = np.random.default_rng(5)
    m = np.zeros((3000, 400))
    m[:, :8] = r.uniform(.1, .4, (3000, 8))  # frequent terms
    for i in range(3000):
        m[i, 8 + r.integers(0, 392, 3)] = 1.0
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    nz, at = np.nonzero(m)
    index = sp.Inverted(np.arange(3000), np.searchsorted(nz, np.arange(3001)), at, m[nz, at])
    query = np.flatnonzero(m[17])
    rows, scores = index.search(query, m[17][query], .8)
    assert set(rows) == set(np.flatnonzero(np.round(m @ m[17], 9) >= .8)) and index.read < .1 * 8 * 3000
    assert index.search(query, m[17][query], 1.2)[0].size == 0


def test_a_hot_bucket_is_dealt_out():
    assert sp.packed([(0, 3), (1, 3), (2, 25), (3, 1), (4, 9)], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 4, 1)]


@pytest.mark.parametrize("measure", ["count", "jaccard"])
def test_own_sets_of_hot_features(spark, monkeypatch, measure):
    """Every user has an own set of hot items, and a third of them share one more: rows joined stay near the input."""
    from wayfunnel.operators import overlap as ov
    r = np.random.default_rng(6)
    sets = {u: {int(x) for x in r.choice(40, 12, replace=False)} | ({99} if u % 3 == 0 else set()) | {1000 + u // 2} for u in range(600)}
    pairs = spark.createDataFrame([(u, i) for u, s in sets.items() for i in s], "u long, i long")
    met = []

    def counted(asked, members, cells, *more, run=sp._tile_search):
        met.append((asked.count(), members.join(cells, "block").count()))
        return run(asked, members, cells, *more)

    monkeypatch.setattr(sp, "_tile_search", counted)
    score = ov.overlap_count if measure == "count" else ov.jaccard
    got = {(x.src, x.dst, x["rank"]) for x in ov.shared_feature_topk(pairs, "u", "i", 5, score, 2, heavy=50).collect()}
    want = set()
    for a, x in sets.items():
        best = sorted((-(len(x & y) if measure == "count" else len(x & y) / len(x | y)), b) for b, y in sets.items() if a != b and len(x & y) > 1)[:5]
        want |= {(a, b, n) for n, (_, b) in enumerate(best, 1)}
    assert got == want
    # the class of every user is met once by each tile of 512 queries: two copies here, and the queries themselves
    assert sum(a + b for a, b in met) <= 4 * len(sets) < pairs.count()
