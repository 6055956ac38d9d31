"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word one token can be the last of the prefix's encoding. It is found among the
vocabulary's entries that end there (an Aho-Corasick automaton lists them) as the one whose own prefix is
encoded already and whose pair with that prefix's last token is compatible: merging the two texts together
gives back those two tokens. Back-pointers then spell the ids. Words repeat, so each worker keeps those it met.
Characters newer than Python's Unicode tables are not lowered.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfunnel.llm._text import Kept, lean

KEPT_WORDS = 150_000  # of a generation, twice


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=1)
def _newer() -> dict[int, int]:
    """Letters and digits that the pattern module knows and Python's older Unicode tables (as the library's) don't.

    Each is mapped to a character that neither knows, which stands in for it while words are found.
    """
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    return {ord(c): 0x378 for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBPE:
    """Encoder for a tokenizer file with lower-casing, a word pattern, byte letters and an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.names = {i: token for token, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: token for token, i in self.specials.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") \
            if self.specials else None
        self.letters = dict(enumerate(_byte_letters()))
        # A token is handled as a string over symbols: a letter, or a letter that ends a word (moved up by 0x10000).
        vocab = {self._symbols(token): i for token, i in model["vocab"].items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[self._symbols(left)], vocab[self._symbols(right)]
            self.ranks.setdefault((a, b), rank)
            self.made.setdefault(vocab[self._symbols(left) + self._symbols(right)], (a, b, self.ranks[a, b]))
        # Entries that no merge makes are reachable as single symbols only.
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.made:
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.compatible = lru_cache(maxsize=1 << 16)(self._compatible)
        self.known = Kept(self._look_up, KEPT_WORDS)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[:-len(self.mark)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return token

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the symbols of ``a`` and ``b`` together never joins across their border.

        The right spine of ``a`` and the left spine of ``b`` list the tokens that touch the border, each with the
        rank at which it is swallowed by the next. A merge across the border happens if at some moment the two
        touching tokens merge before either is swallowed; at equal ranks the left place goes first.
        """
        never = len(self.ranks) + 1
        left, right = [(a, never)], [(b, never)]
        while left[-1][0] in self.made:
            left.append(self.made[left[-1][0]][1:])
        while right[-1][0] in self.made:
            first, _, rank = self.made[right[-1][0]]
            right.append((first, rank))
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.ranks.get((x, y), never + 1)
            # x is swallowed from its left at x_until: that place lies before the border, so it wins a tie
            if across < x_until and across <= y_until:
                return False
            if x_until == y_until == never:
                return True
            if x_until <= y_until:
                i -= 1
            else:
                j -= 1

    def word_ids(self, symbols: str) -> list[int]:
        """Ids of one word; a symbol without an entry is left out, as the model has no unknown token."""
        last: list[int] = [-1] * (len(symbols) + 1)
        size = [0] * (len(symbols) + 1)
        reached = [True] + [False] * len(symbols)
        for at, (token, length) in self.automaton.iter(symbols):
            end, start = at + 1, at + 1 - length
            if not reached[end] and reached[start] and (start == 0 or self.compatible(last[start], token)):
                last[end], size[end], reached[end] = token, length, True
        out, at = [], len(symbols)
        if not reached[at]:
            raise ValueError("the vocabulary lacks a byte")
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _look_up(self, word: str) -> tuple[str, str]:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = self.word_ids(letters[:-1] + chr(ord(letters[-1]) + 0x10000))
        return " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def _words(self, text: str) -> list[str]:
        if text.isascii() or _latin(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(_newer()))]

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """For each word or special token: ids and names."""
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield str(self.specials[piece]), piece
                continue
            if not piece.isascii():
                # letters are lowered one by one, so a sigma at a word's end is as any other
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            yield from self.known.parts(self._words(piece.lower()))

    def encoded(self, text: str) -> tuple[str, str, int]:
        """Ids and token names, each joined by one space (the library's decoding without a decoder), and their number."""
        parts = list(self._parts(text))
        ids = " ".join([p[0] for p in parts])
        return ids, " ".join([p[1] for p in parts]), ids.count(" ") + bool(ids)


_encoders: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """One encoder for a file and worker."""
    if path not in _encoders:
        _encoders[path] = WordBPE(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", *, ids: bool = True,
           decoded: bool = True) -> DataFrame:
    """Encode every whole text with the tokenizer file ``path`` and decode the ids again.

    Returns a row for each input row: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space),
    ``decoded_sha256``, and, where asked for, ``ids`` (array of int) and ``decoded``. Null and empty texts have no
    ids; repeated rows are encoded each; other columns are not read. A map without a shuffle: a lost executor's
    part is computed again.
    """
    kind = docs.schema[id_column].dataType
    fields = [T.StructField(id_column, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                done = [bpe.encoded(text or "") for text in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([d[2] for d in done], pa.int64()),
                           pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string()),
                           pa.array([hashlib.sha256(d[1].encode()).hexdigest() for d in done], pa.string())]
                if ids:
                    columns.append(pa.array([[int(i) for i in d[0].split()] for d in done], pa.list_(pa.int32())))
                if decoded:
                    columns.append(pa.array([d[1] for d in done], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_column, text_column).mapInArrow(lean(run), T.StructType(fields))
