import base64
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfunnel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.one_of(st.text(), st.text("ab c\n\t\r'sé  \x0b1.")))
@settings(max_examples=300, deadline=None)
def test_ids_as_the_library(text):
    assert packing.encoder(PATH).ids(text).tolist() == LIBRARY.encode_ordinary(text)


def test_best_fit():
    r = random.Random(2)
    for _ in range(40):
        length = r.randint(1, 60)
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 80))]
        rooms, rows = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [x for x in rooms if x >= sizes[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= sizes[i]
            else:
                rooms.append(length - sizes[i])
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for row in got for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in got) == sorted(rooms)


def test_round_trip(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "é", "of\n", "retitioning", "x1"]) for _ in range(r.choice([0, 1, 5, 40, 400]))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "null id", 0)], "doc_id long, text string, ids int")
    rows = packing.packed(docs, PATH, 64, group_bytes=3000).collect()
    assert len({x.group for x in rows}) > 1
    parts = {}
    for x in rows:
        ids, positions = (np.frombuffer(v, "<u4") for v in (x.ids, x.positions))
        assert len(ids) == len(positions) == 64 and x.cu_seqlens[-1] == x.n_tokens <= 64 and x.n_segments == len(x.segments)
        for segment, a, b in zip(x.segments, x.cu_seqlens, x.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(segment.id, {})[segment.first] = ids[a:b].tolist()
        assert set(ids[x.n_tokens:]) <= {50256} and not positions[x.n_tokens:].any()
    for i, t in [*enumerate(texts), (None, "null id")]:
        own = parts.get(i, {})
        ids = [x for at in sorted(own) for x in own[at]]
        assert ids == LIBRARY.encode_ordinary(t or "") and LIBRARY.decode(ids) == (t or "")
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_a_text_is_encoded_at_once(monkeypatch):
    own, calls = packing.Encoder(PATH), []
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda text: (calls.append(text), encode(text))[1])
    text = " ".join(f"word{i}" for i in range(300))
    assert own.ids(text).tolist() == LIBRARY.encode_ordinary(text) and calls == [text]
