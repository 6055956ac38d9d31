import math
import random
import re
from collections import Counter

from wayfunnel.llm import lexical

TERM = re.compile(lexical.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k):
    bags = [(i, Counter(split(t))) for i, t in documents]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = set()
    for item, text in texts.items():
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in set(split(text)) if t in b)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out |= {(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)}
    return out


def found(documents, items, k):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(documents, items, k).collect()}


def words(r, n, skew=1.6):
    return " ".join(f"w{int(r.paretovariate(skew))}" for _ in range(n))


def test_all_scores(spark, monkeypatch):
    r = random.Random(3)
    documents = [(i, words(r, r.randrange(1, 60), .7)) for i in range(2500)]
    documents += [(i, "W1 w2, ÉTÉ été w3") for i in range(5000, 5040)] + [(7, documents[7][1])] * 3  # ties and repeated rows
    documents += [(8000, None), (8001, ""), (8002, " .,\n"), (None, "w1 w2 rare"), (8003, "w1 " * 300_000 + "rare")]
    items = [(i, words(r, 12, .5)) for i in range(30)] + [(50, "été"), (51, "W1"), (52, "rare w2"), (53, "unheard of"), (54, None), (54, ""),
                                                          (55, "w9 w8"), (55, "w7 w6"), (None, "w3 w4")]
    d = spark.createDataFrame(documents, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as score", "2 as item_id", "3 as n")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as terms")
    expected = brute(documents, items, 10)
    assert found(d.repartition(3), q, 10) == expected
    monkeypatch.setattr(lexical, "BATCH_TERMS", 40)  # several batches
    monkeypatch.setattr(lexical, "WINDOW", 16)  # many looks at the score to beat, few short lists
    monkeypatch.setattr(lexical, "PIECE", 5)
    assert found(d.coalesce(1), q, 10) == expected
    assert found(d, q, 1) == {x for x in expected if x[1] == 1}


def test_lists_are_skipped(monkeypatch):
    """Once the best are known, documents that only hold frequent terms are not looked at."""
    import numpy as np
    n = 20_000
    sizes = np.full(n, 2)
    sizes[:20] = 3
    terms = np.concatenate([[0, 1, 2] if s == 3 else [0, 1] for s in sizes])
    block = lexical.Block(np.arange(n), np.full(n, 100), sizes, terms, np.ones(len(terms), np.int64), np.array([3, 4, 9000]))
    best, looked = lexical.Best(10), []
    monkeypatch.setattr(lexical.Best, "add", lambda self, s, i, add=lexical.Best.add: (looked.extend(i), add(self, s, i))[1])
    block.search([0, 1, 2], best)
    assert best.ids.tolist() == list(range(10)) and len(looked) <= lexical.WINDOW


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id int, text string")
    assert found(d, q.limit(0), 10) == set()
    assert found(d.limit(0), q, 10) == set()
    assert found(spark.createDataFrame([(1, None), (2, "")], d.schema), q, 10) == set()
    assert [tuple(x) for x in lexical.search(d, q).collect()] == [(1, 1, 1, 287 * (10 ** 9 // (1000 + 800)))]
    assert lexical.search(d, q).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
