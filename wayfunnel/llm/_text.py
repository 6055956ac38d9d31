"""Helpers over Arrow text columns: bytes and offsets, slices of bounded size, fingerprints, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def lean(run: Callable) -> Callable:
    """``run`` for a map over Arrow batches; at a task's end the worker, which is used again, gives free memory back."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Kept:
    """What ``make`` made of words met before, in two generations of at most ``count`` words each.

    A full generation replaces the older one, and a word found there moves on, so frequent words stay. Words of more than
    ``longest`` characters are made anew each time.
    """

    def __init__(self, make: Callable, count: int, longest: int = 64):
        self.make, self.count, self.longest = make, count, longest
        self.young: dict = {}
        self.old: dict = {}

    def parts(self, words: list[str]) -> list:
        out = list(map(self.young.get, words))
        if None in out:
            for i, part in enumerate(out):
                if part is None:
                    out[i] = self._missed(words[i])
        return out

    def _missed(self, word: str):
        part = self.young.get(word)  # met earlier in the same text
        if part is None:
            part = self.old.get(word)
            if part is None:
                part = self.make(word)
            if len(word) <= self.longest:
                if len(self.young) >= self.count:
                    self.old, self.young = self.young, {}
                self.young[word] = part
        return part


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together; a longer text is alone."""
    lo, count = 0, len(offsets) - 1
    while lo < count:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1), kept for the longest count seen."""
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        size = max(count, 1 << 16)
        out = np.ones(size, np.uint64)
        out[1:] = base
        _powers[int(base)] = known = np.multiply.accumulate(out)
    return known[:count]


class Prints:
    """Fingerprints of any range of a sequence of 64-bit codes, from one pass of prefix sums."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _power(_BASE, len(codes)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        powers = _power(_INVERSE, len(self.sums))
        return mixed((self.sums[ends] - self.sums[starts]) * powers[starts])

    def every(self, length: int) -> np.ndarray:
        """Fingerprints of all ranges of ``length`` codes."""
        count = len(self.sums) - length
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:count]) * _power(_INVERSE, count))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; none reaches over an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


_GAP = np.zeros(256, bool)
_GAP[list(SPACES)] = True
_NO_TERM = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _NO_TERM[_first:_last + 1] = False


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: starts, ends, and each text's first word (one more entry than texts)."""
    starts, ends = runs_of(~gap[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of ASCII letters, digits and any other characters beyond ASCII, as ``words`` gives them."""
    return words(data, offsets, _NO_TERM)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return data + upper * np.uint8(32)


def row_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """128 bits that name a row by its id and text; equal rows share a key and any verdict on it."""
    i, t = df[id_column], df[text_column]
    return [F.xxhash64(i, t).alias("_r1"), F.xxhash64(F.lit(7), t, i).alias("_r2")]
