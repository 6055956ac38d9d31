"""Removal of byte strings that occur more than once, by a logarithmic family of sparse suffix arrays.

A batch's suffix array holds the suffixes that start at content-chosen anchors (see ``_repeats``), ordered by the
fingerprint of their first bytes. A new batch is merge-scanned against the levels that exist: seeds met on both
sides are the long matches. It then becomes a level, and levels of one size merge, so that a suffix is rewritten a
logarithmic number of times and ``b`` batches leave at most ``log2(b) + 1`` levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.llm import _repeats
from wayfunnel.llm._tables import Scratch, union
from wayfunnel.llm._text import Prints, byte_codes, row_key, utf8

LENGTH = 400
BATCHES = 4
PART = 16


class SuffixFamily:
    """Levels of suffix arrays: the anchors' short seeds in order, with their number of occurrences ``n``."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame, str]] = []  # batches within, entries, place
        self.matches: list[DataFrame] = []

    @staticmethod
    def _folded(entries: DataFrame) -> DataFrame:
        return entries.groupBy("seed").agg(F.sum("n").alias("n"))

    def _level(self, entries: DataFrame, size: int) -> None:
        self.levels.append((size, *self.scratch.write(entries.sortWithinPartitions("seed"))))

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch; returns the seeds of its long matches, with itself and with earlier batches."""
        short = F.col("seed").bitwiseAND(F.lit(_repeats.SHORT))
        self._level(self._folded(suffixes.select(short.alias("seed"), F.lit(1).cast("long").alias("n"))), 1)
        own = self.levels[-1][1]
        met = [own.filter("n >= 2").select("seed")]
        met += [own.select("seed").join(level.select("seed"), "seed", "left_semi") for _, level, _ in self.levels[:-1]]
        found = self.scratch.table(union(met))
        self.matches.append(found)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, at_a), (_, b, at_b) = self.levels[-2:]
            del self.levels[-2:]
            self._level(self._folded(a.unionByName(b)), 2 * size)
            self.scratch.drop(at_a)
            self.scratch.drop(at_b)
        return found

    def repeated(self) -> DataFrame:
        """Seeds of all matches; some are listed twice."""
        return union(self.matches)


def _scan(length: int, seed: int) -> _repeats.Scan:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[_repeats.Piece]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for a, b, inner, row, base in _repeats.pieces(offsets, length):
                prints = Prints(byte_codes(data[a:b]))
                yield _repeats.Piece(prints, keys, row, inner, base, *_repeats.stretches(prints, inner, length, seed))

    return scan


def without_repeats(docs: DataFrame, length: int = LENGTH, *, seed: int | None = None, batches: int = BATCHES,
                    id_column: str = "doc_id", text_column: str = "text", kept: bool = True) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts at another place as well.

    Returns a row for each input row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, where asked for, ``kept`` (binary, as a cut may split a character). Null texts count as
    empty; texts under ``length`` bytes lose nothing; a repeated row counts as another document, so both lose their
    text; other columns are not read. ``docs`` must be a stable plan (a table), as it is read several times.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    seed = seed or max(1, length // 2)
    scan = _scan(length, seed)
    keyed = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), *row_key(docs, id_column, text_column))
    found = scratch.table(_repeats.parts(keyed, scan, length))
    family = SuffixFamily(scratch)
    for k in range(batches):
        family.add(found.filter(F.pmod("_r1", F.lit(batches)) == k))
    sizes = tuple(x for x in (PART,) if x < length // 8) + (1,)
    ranges = _repeats.covered(scratch, keyed, found, family.repeated(), scan, length, sizes)
    kind = docs.schema[id_column].dataType
    fields = [T.StructField(id_column, kind), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
              T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.BinaryType())] * kept]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                data, offsets = utf8(part.column(1))
                removed, spans, digests, left = [], [], [], []
                for i, ranges in enumerate(part.column(2).to_pylist()):
                    text = data[offsets[i]:offsets[i + 1]]
                    gaps = _repeats.merged(ranges)
                    if len(gaps):
                        inside = np.zeros(len(text) + 1, np.int8)
                        inside[gaps[:, 0]] += 1
                        inside[gaps[:, 1]] -= 1
                        text = text[np.cumsum(inside[:-1], dtype=np.int8) == 0]
                    removed.append(int((gaps[:, 1] - gaps[:, 0]).sum()))
                    spans.append(len(gaps))
                    text = text.tobytes()
                    digests.append(hashlib.sha256(text).hexdigest())
                    if kept:
                        left.append(text)
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                           pa.array(digests, pa.string()), *[pa.array(left, pa.binary())] * kept]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return _repeats.finished(keyed, ranges, cut, T.StructType(fields))
