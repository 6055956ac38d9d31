import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfunnel.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.encoder(PATH)


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False), len(ids)


# code points of Unicode versions newer than Python's tables are left out: the library's parts do not agree on them
@given(st.one_of(st.text(st.characters(exclude_categories=("Cs", "Cn"))), st.text("abcdeilmnorstu 'ÀéßΣσς  \x1c\x85.,!12<|endoftext|>")))
@settings(max_examples=400, deadline=None)
def test_any_text_as_the_library(text):
    assert OURS.encoded(text) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "\n", "a" * 3000, "the " * 500, "it's we'll I'D", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>",
                                  "é Ελλάς ΣΑΣ", "안녕하세요 日本語", "İstanbul 12345", "ﬁ½²", "a‍b", "Ünïcödé ThTh"])
def test_cases(text):
    assert OURS.encoded(text) == expected(text)


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == 5
    for row, (i, text, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)),
                                 sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), strict=True):
        ids, decoded, n = expected(text or "")
        assert (row.doc_id, row.n_tokens, row.decoded) == (i, n, decoded)
        assert row.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert " ".join(map(str, row.ids)) == ids
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_frequent_words_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 8)
    looked_up, look_up = [], bpe.WordBPE._look_up
    monkeypatch.setattr(bpe.WordBPE, "_look_up", lambda self, word: (looked_up.append(word), look_up(self, word))[1])
    ours = bpe.WordBPE(PATH)
    for i in range(60):
        text = f"common x{chr(97 + i % 26)}{chr(97 + i // 26)} rare"
        assert ours.encoded(text) == expected(text)
    assert looked_up.count("common") == looked_up.count("rare") == 1
