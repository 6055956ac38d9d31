import random

import pytest

from wayfunnel.llm import tiling


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: the longest unmarked match, leftmost, again and again."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        for x in range(n):
            free_a[i + x] = free_b[j + x] = False


@pytest.mark.parametrize("seed", range(6))
def test_tiles(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abc") for _ in range(60)] for _ in range(2))
    k = 3
    places = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i:i + k] == b[j:j + k]]
    assert tiling.tiles(places, k) == brute_tiles(a, b, k)


def test_marked(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(12, 40)) for _ in range(12)] + [text(3)]
    rows = []
    for i in range(80):
        own = text(r.randint(0, 60))
        for _ in range(i % 3):
            item = r.choice(items)
            cut = r.randint(1, len(item) - 1)
            passage = item[cut:] + text(2) + item[:cut] if i % 2 else item[:r.randint(3, len(item))]
            at = r.randint(0, len(own))
            own[at:at] = passage
        rows.append((i, (", " if i % 5 == 0 else " ").join(w.upper() if i % 7 == 0 else w for w in own)))
    rows += [(500, None), (501, ""), (None, " ".join(items[0])), (0, rows[0][1])]
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)] + [(0, " ".join(items[0]), "x"), (99, None, "x")],
                                  "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, item_id string")
    got = sorted((tuple(x) for x in tiling.marked(docs, bench).collect()), key=str)
    expected = []
    for i, t in rows:
        words = (t or "").lower().replace(",", " ").split()
        shares = [(-sum(x[2] for x in brute_tiles(words, item, 5)) / len(item), k) for k, item in enumerate(items)]
        shares = sorted(x for x in shares if -x[0] >= 0.5)
        expected.append((i, bool(shares), len(shares), shares[0][1] if shares else None, -shares[0][0] if shares else None))
    assert got == sorted(expected, key=str)
    left = tiling.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(x[0]) for x in expected if not x[1])
    assert tiling.marked(docs.limit(0), bench).count() == 0
    assert {x.contaminated for x in tiling.marked(docs, bench.limit(0)).collect()} == {False}
