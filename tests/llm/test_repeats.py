import hashlib
import random

import pytest

from wayfunnel.llm import debruijn, substrings

SCHEMA = "doc_id long, text string, kept string, ranges string"


def covered(sequences, width):
    """Brute force: which places of each sequence lie in a window met at another place as well."""
    seen = {}
    for d, s in enumerate(sequences):
        for i in range(len(s) - width + 1):
            seen.setdefault(tuple(s[i:i + width]) if isinstance(s, list) else s[i:i + width], []).append((d, i))
    out = [[False] * len(s) for s in sequences]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i:i + width] = [True] * width
    return out


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(60)] + ["a", "the", "x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(40) for _ in range(4)]
    docs = [text(r.randint(0, 90)) for _ in range(30)]
    docs += [f"{text(r.randint(0, 15))} {r.choice(shared)} {text(r.randint(0, 15))}" for _ in range(40)]
    for _ in range(15):  # near copies
        own = r.choice(docs).split(" ")
        own[r.randrange(len(own))] = "edit"
        docs.append("  ".join(own))
    docs += [docs[3]] * 4 + ["", " \n\t", None, "ab" * 300, "a " * 200, "a" * 500, "\x0b" + shared[0] + "\r\n" + shared[0]]
    return docs


@pytest.mark.parametrize(("width", "seed"), [(5, 2), (8, 3), (20, 8)])
def test_word_windows(spark, width, seed):
    texts = corpus(width)
    docs = spark.createDataFrame([(i, t, "c", None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in debruijn.without_repeats(docs, width, seed=seed).collect()}
    sequences = [(t or "").encode().split() for t in texts]
    assert len(got) == len(texts)
    for i, (s, gone) in enumerate(zip(sequences, covered([list(x) for x in sequences], width), strict=True)):
        left = b" ".join(w for w, g in zip(s, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode()) == (len(s), sum(gone), left)
        assert got[i].kept_sha256 == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("width", [20, 50, 130])
def test_byte_strings(spark, width):
    texts = corpus(width)
    docs = spark.createDataFrame([(i, t, "c", None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in substrings.without_repeats(docs, width, batches=5).collect()}
    sequences = [(t or "").encode() for t in texts]
    for i, (s, gone) in enumerate(zip(sequences, covered(sequences, width), strict=True)):
        left = bytes(b for b, g in zip(s, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(s), sum(gone), spans, left)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    from wayfunnel.llm import _repeats
    monkeypatch.setattr(_repeats.pieces, "__defaults__", (150,))
    texts = corpus(1) + [" ".join(t or "" for t in corpus(2)), " ".join(t or "" for t in corpus(3)[::-1])]
    sequences = [(t or "").encode() for t in texts]
    import numpy as np

    from wayfunnel.llm._text import Prints, byte_codes
    data = np.frombuffer(b"".join(sequences), np.uint8)
    offsets = np.cumsum([0, *map(len, sequences)])
    windows = set()
    for a, b, inner, doc, base in _repeats.pieces(offsets, 30, 150):
        at, first, count, *_ = _repeats.stretches(Prints(byte_codes(data[a:b])), inner, 30, 7)
        for d, f, n in zip(at, first, count, strict=True):
            for i in range(f, f + n):
                window = (int(doc + d), int(i - inner[d] + base))
                assert window not in windows
                windows.add(window)
    assert windows == {(d, i) for d, s in enumerate(sequences) for i in range(len(s) - 29)}


def test_edge_rows(spark):
    text = "one two three four five six"
    rows = [(1, text, "a", "b"), (1, text, "a", "b"), (None, "seven eight nine ten", None, None), (2, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(debruijn.without_repeats(docs, 3).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got] == [(None, 4, 0), (1, 6, 6), (1, 6, 6), (2, 0, 0)] or \
        sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 4, 0), (1, 6, 6), (1, 6, 6), (2, 0, 0)]
    assert debruijn.without_repeats(docs.limit(0)).count() == 0
    assert substrings.without_repeats(docs.filter("doc_id > 5")).count() == 0
