"""Neighbours are sent to tiles: what is shuffled follows the number of tiles, not that of blocks."""

import numpy as np
import pytest

from wayfunnel.operators import nearest as nn
from wayfunnel.operators import overlap as ov
from wayfunnel.operators import sparse as sp


def shuffled(spark, df):
    """Bytes that computing ``df`` writes for exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages, n = store.stageList(None, False, False, none, None).iterator(), 0
        while stages.hasNext():
            n += stages.next().shuffleWriteBytes()
        return n

    before = total()
    got = df().collect()
    return total() - before, got


@pytest.mark.parametrize("metric", ["cosine", "cityblock"])
def test_small_blocks_send_no_more(spark, metric):
    r = np.random.default_rng(1)
    m = r.normal(size=(1500, 16))
    m[100:160] = m[100]  # copies, more than the neighbours asked for
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, val array<double>").repartition(4).persist()
    sent, got = shuffled(spark, lambda: nn.nearest(points, 5, metric, block_rows=40))
    s = np.round(nn._scores(m, m, metric), 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j), rank) for i in range(len(m)) for rank, j in enumerate(np.lexsort((np.arange(len(m)), -s[i]))[:5], 1)}
    assert {(x.src, x.dst, x["rank"]) for x in got} == want
    assert sent < 20 * points.count() * (16 * 8 + 60)  # 38 blocks


def test_sparse_rows_are_sent_to_few_tiles(spark):
    r = np.random.default_rng(2)
    rows = [(i, sorted(int(x) for x in r.choice(400, 30, replace=False)), r.uniform(.1, 1, 30).tolist()) for i in range(4000)]
    points = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(4).persist()
    sent, got = shuffled(spark, lambda: sp.sparse_topk(points, 3))
    assert len(got) == 3 * 4000
    assert sent < 9 * points.count() * 30 * 12  # it was sent to each 512 rows


@pytest.mark.parametrize("score", [ov.overlap_count, ov.jaccard])
def test_pairs_are_not_shuffled(spark, score):
    r = np.random.default_rng(3)
    taken = [(u, int(i)) for u in range(400) for i in r.choice(500, 40, replace=False)]
    pairs = spark.createDataFrame(taken, "u long, i long").repartition(4).persist()
    sent, got = shuffled(spark, lambda: ov.shared_feature_topk(pairs, "i", "u", 3, score))
    m = np.zeros((500, 400), int)
    for u, i in taken:
        m[i, u] = 1
    common, size = m @ m.T, m.sum(axis=1)
    s = common if score is ov.overlap_count else common / np.maximum(size[:, None] + size[None, :] - common, 1)
    want = set()
    for i in range(500):
        best = sorted((-s[i, j], j) for j in range(500) if j != i and common[i, j])[:3]
        want |= {(i, j, n) for n, (_, j) in enumerate(best, 1)}
    assert {(x.src, x.dst, x["rank"]) for x in got} == want
    assert sent < 400 * 40 * 40 * 20 / 4  # 640,000 pairs of 20 bytes or more
