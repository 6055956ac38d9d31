import random

import numpy as np
from pyspark.sql import functions as F

from wayfunnel.llm import forest
from wayfunnel.llm._components import components
from wayfunnel.llm._tables import Scratch


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)], least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 12])):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 12))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(("  " if r.random() < .5 else " ").join(own).upper() if r.random() < .2 else " ".join(own))
    chain = [r.choice(vocabulary) for _ in range(100)]
    for _ in range(12):  # each like the one before it, not like the first
        chain = list(chain)
        chain[r.randrange(100)] = chain[r.randrange(100)] + "x"
        chain[r.randrange(100)] += "y"
        texts.append(" ".join(chain))
    texts += [None, "", " \n", "a", "A", "a b", "a a a a", "a a", "é È", texts[0], texts[0]] + [texts[3]] * 30
    r.shuffle(texts)
    return list(enumerate(texts, 100))


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    for size in (2, 5):
        got = sorted(tuple(r) for r in forest.near_duplicates(docs, size).collect())
        assert got == sorted(brute(rows, size, 80))


def test_edges_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (None, "z"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in forest.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (None, 0, None, True), (None, 1, None, True),
                          (3, 0, 3, True)], key=str)
    assert forest.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, j) for j in range(201, 300)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(80)]
    r.shuffle(edges)
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges for i in (a, b) if a != b}


def family(members, planted, seed=3):
    """Distinct texts that are alike at 0.6 to 0.79, and pairs just over 0.8 among them."""
    r = random.Random(seed)
    base = [f"word{i}" for i in range(200)]

    def changed(words, count):
        own = list(words)
        for i in r.sample(range(200), count):
            own[i] = f"own{r.random()}"
        return own

    texts = [changed(base, 10) for _ in range(members)]
    texts += [changed(t, 10) for t in texts[:planted]]
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_dense_family(spark):
    rows = family(1100, 60)
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    column = {x: i for i, x in enumerate(set().union(*sets))}
    there = np.zeros((len(sets), len(column)), np.float32)
    for i, own in enumerate(sets):
        there[i, [column[x] for x in own]] = 1
    shared, count = there @ there.T, there.sum(axis=1)
    alike = 100 * shared >= 80 * (count[:, None] + count - shared)
    linked = [(int(b), int(a)) for a, b in zip(*np.nonzero(alike), strict=True) if a < b]
    assert len(linked) == len({i for pair in linked for i in pair}) / 2 == 60  # pairs of their own
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = forest.near_duplicates(docs, 2).filter("not kept").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(linked)


def test_pairs_at_the_limit_meet(spark):
    """Of 20,000 pairs of signatures that agree at each hash with a probability of 0.8 nearly all share a neighbourhood."""
    r, count = np.random.default_rng(5), 20_000
    kind = forest.signatures(np.zeros(1, np.uint64), np.array([0, 1])).dtype
    one, other = r.integers(0, 1 << 8 * kind.itemsize, (2, count, forest.HASHES), kind)
    other = np.where(r.random(one.shape) < 0.8, one, other)
    rows = [(i, x.tobytes()) for i, x in enumerate(np.stack([one, other], axis=1).reshape(2 * count, -1))]
    near = forest._neighbourhoods(spark.createDataFrame(rows, "id long, sketch binary"))
    pair = F.floor(F.col("id") / 2).alias("pair")
    met = near.groupBy(near.columns[0], pair).count().filter("count > 1").select("pair").distinct().count()
    assert count - met <= 2


def test_rows_of_a_dense_region_follow_its_members(spark):
    """300 classes, all alike and each a component: every two are compared, but no row is made for each two."""
    rows = [(7, 0, i, i, 301, 0, 1, 299, bytes(forest.HASHES)) for i in range(300)]
    dense = spark.createDataFrame(rows, "k long, tree int, id long, component long, n long, main long, inside long, outside long, sketch binary")
    cells = forest._cells(dense, 80).collect()
    pairs = [tuple(sorted((r.id, x))) for r in cells for x in r.others]
    assert len(pairs) == len(set(pairs)) == 300 * 299 / 2
    assert len(cells) <= 300 * 3  # the outside has two blocks and the largest component one
    texts = spark.createDataFrame([(i, "a b c d e f g") for i in range(300)], "id long, text string")
    cells = spark.createDataFrame(cells, forest._cells(dense, 80).schema)
    links = forest._confirmed_cells(cells, texts, 2, 80).collect()
    got = components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert len(links) <= 300 * 3 and {(r.id, r.component) for r in got} == {(i, 0) for i in range(300)}
