"""Removal of repeated word windows through the compacted de Bruijn graph of the corpus.

An edge is a window of ``length`` words, a node the ``length - 1`` words that two neighbouring edges share. Edges are
kept as paths of consecutive edges with one anchor (see ``_repeats``): within such a path no node branches, since its
words are written out between the path's ends. Spark joins compact on that: a path met again as a whole is one repeated
path; where paths share an anchor but differ, the graph branches, and their edges are counted singly. The source
coordinates (row, first word) of all repeated edges give each row's repeated spans.
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
from wayfunnel.llm._tables import Scratch
from wayfunnel.llm._text import Prints, byte_codes, row_key, slices, utf8, words

LENGTH = 35
SEED = 16


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit print of each word, made over blocks of bounded size."""
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        a = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, a + block, side="right")))
        out[lo:hi] = Prints(byte_codes(data[a:ends[hi - 1]])).of(starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def _scan(length: int, seed: int) -> _repeats.Scan:
    """Paths of edges with one anchor, from the texts of a batch."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[_repeats.Piece]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for lo, hi in slices(offsets):
                part = data[offsets[lo]:offsets[hi]]
                starts, ends, firsts = words(part, offsets[lo:hi + 1] - offsets[lo])
                codes = word_codes(part, starts, ends)
                for a, b, inner, row, base in _repeats.pieces(firsts, length):
                    prints = Prints(codes[a:b])
                    yield _repeats.Piece(prints, keys, lo + row, inner, base, *_repeats.stretches(prints, inner, length, seed))

    return scan


def without_repeats(docs: DataFrame, length: int = LENGTH, *, seed: int = SEED, id_column: str = "doc_id",
                    text_column: str = "text", kept: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that starts at another place as well.

    Returns a row for each input row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by
    one space) and, where asked for, ``kept`` (that text). Null and empty texts have no words; texts under ``length``
    words lose nothing; a repeated row counts as another document, so both lose their words; other columns are not
    read. ``docs`` must be a stable plan (a table), as it is read several times.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    scan = _scan(length, min(seed, length))
    keyed = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), *row_key(docs, id_column, text_column))
    found = scratch.table(_repeats.parts(keyed, scan, length))
    ranges = _repeats.covered(scratch, keyed, found, _repeats.repeated_seeds(found), scan, length, (1,))
    kind = docs.schema[id_column].dataType
    fields = [T.StructField(id_column, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.StringType())] * kept]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 256):
                rows = part.slice(lo, 256)
                counts, removed, left = [], [], []
                for text, ranges in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    own = (text or "").encode().split()
                    counts.append(len(own))
                    for start, stop in _repeats.merged(ranges)[::-1].tolist():
                        del own[start:stop]
                    removed.append(counts[-1] - len(own))
                    left.append(b" ".join(own))
                columns = [rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
                if kept:
                    columns.append(pa.array([x.decode() for x in left], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return _repeats.finished(keyed, ranges, cut, T.StructType(fields))
