"""Removal of lines common to many documents, by levelled sorted runs of line hashes.

Each batch of documents gives a run: its line hashes with the number of its documents that hold each, sorted by hash.
Hashes already settled as common are left out by a merge anti-join with the settled run, so a line of every document
costs nothing in later batches. After ``fanout`` runs these are compacted into one, and the settled run is renewed.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.llm._tables import Bits, Scratch, union
from wayfunnel.llm._text import SPACES, lean, row_key

BATCHES = 4
FANOUT = 3


class LineRuns:
    """Sorted runs of (``low``, ``high``, ``n``): a line's 128-bit hash and the number of documents with it."""

    def __init__(self, scratch: Scratch, least: int, fanout: int = FANOUT):
        self.scratch, self.least, self.fanout = scratch, least, fanout
        self.runs: list[tuple[DataFrame, str]] = []
        self.settled: DataFrame | None = None

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("low", "high").agg(F.sum("n").alias("n"))

    def add(self, lines: DataFrame) -> None:
        fresh = self._counted(lines)
        if self.settled is not None:
            fresh = fresh.join(self.settled, ["low", "high"], "left_anti")
        self.runs.append(self.scratch.write(fresh.sortWithinPartitions("low", "high")))
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        old = self.runs
        rows = self._counted(union([r for r, _ in old])).sortWithinPartitions("low", "high")
        self.runs = [self.scratch.write(rows)]
        for _, place in old:
            self.scratch.drop(place)
        self.settled = self.runs[0][0].filter(F.col("n") >= self.least).select("low", "high")

    def common(self) -> DataFrame:
        """Hashes of lines that at least ``least`` documents hold."""
        self.compact()
        return self.settled


def _key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # of bytes: A-Z only


def _halves(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as two signed 64-bit columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _lines(keyed: DataFrame, batches: int, least_length: int) -> DataFrame:
    """Line hashes of every document once, summed up within a part of the input; ``batch`` deals documents out."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts: list[Counter] = [Counter() for _ in range(batches)]
            for batch, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                if text:
                    counts[batch].update({k for k in map(_key, text.encode().split(b"\n"))
                                          if k and (least_length < 2 or len(k.decode()) >= least_length)})
            for batch, count in enumerate(counts):
                if count:
                    halves = _halves(list(count))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(count), batch, np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                         pa.array(list(count.values()), pa.int64())], names=["batch", "low", "high", "n"])

    return (keyed.select(F.pmod("_r1", F.lit(batches)).cast("int").alias("batch"), "text")
            .mapInArrow(lean(run), "batch int, low long, high long, n long"))


def _places(keyed: DataFrame, bits: Bits) -> DataFrame:
    """Places of the lines whose hash passes the filter."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p.slice(lo, 1024) for p in parts for lo in range(0, p.num_rows, 1024)):
            keys = [part.column(i).to_numpy() for i in (0, 1)]
            rows, places, lines = [], [], []
            for row, text in enumerate(part.column(2)):
                own = (text.as_py() or "").encode().split(b"\n")
                rows.append(np.full(len(own), row))
                places.append(np.arange(len(own), dtype=np.int32))
                lines += map(_key, own)
            if not rows:
                continue
            halves, rows, places = _halves(lines), np.concatenate(rows), np.concatenate(places)
            hit = bits.has(halves[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (keys[0][rows[hit]], keys[1][rows[hit]], places[hit], halves[hit, 0], halves[hit, 1])],
                names=["_r1", "_r2", "place", "low", "high"])

    return keyed.select("_r1", "_r2", "text").mapInArrow(lean(run), "_r1 long, _r2 long, place int, low long, high long")


def _dropped(docs: DataFrame, least: int, least_length: int, batches: int, id_column: str, text_column: str) -> DataFrame:
    """``docs`` with ``_gone``: the places of the common lines; null where there are none."""
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = docs.withColumns({n: c for n, c in zip(("_r1", "_r2"), row_key(docs, id_column, text_column), strict=True)})
    slim = keyed.select("_r1", "_r2", F.col(text_column).alias("text"))
    lines = scratch.table(_lines(slim, batches, least_length), "batch")
    runs = LineRuns(scratch, least)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k))
    common = runs.common()
    gone = (_places(slim, Bits(common)).join(common, ["low", "high"], "left_semi")
            .groupBy("_r1", "_r2").agg(F.collect_set("place").alias("_gone")))
    return keyed.join(gone, ["_r1", "_r2"], "left").drop("_r1", "_r2")


def common_lines(docs: DataFrame, least: int = 10, *, least_length: int = 1, batches: int = BATCHES,
                 id_column: str = "doc_id", text_column: str = "text", kept: bool = True) -> DataFrame:
    """Drop the lines whose key at least ``least`` documents hold from every document; a digest for each row.

    A key is the line without outer white space, A-Z lower-cased; keys under ``least_length`` code points stay. Returns
    for each input row the id, ``n_lines``, ``n_dropped``, ``kept_sha256`` and, where asked for, ``kept``. Null and
    empty texts are one empty line, which stays; each repeated row counts as a document; other columns are not read.
    ``docs`` must be a stable plan (a table), as it is read several times.
    """
    kind = docs.schema[id_column].dataType
    fields = [T.StructField(id_column, kind), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
              T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.StringType())] * kept]
    slim = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p.slice(lo, 512) for p in parts for lo in range(0, p.num_rows, 512)):
            counts, dropped, left = [], [], []
            for text, gone in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                lines = (text.as_py() or "").split("\n")
                counts.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [x for i, x in enumerate(lines) if i not in gone]
                dropped.append(counts[-1] - len(lines))
                left.append("\n".join(lines))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()),
                       pa.array([hashlib.sha256(x.encode()).hexdigest() for x in left], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.string())] * kept, names=[f.name for f in fields])

    return (_dropped(slim, least, least_length, batches, "_id", "_text").select("_id", "_text", "_gone")
            .mapInArrow(lean(cut), T.StructType(fields)))


def without_common_lines(docs: DataFrame, least: int = 10, *, least_length: int = 1, batches: int = BATCHES,
                         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns and the common lines dropped from ``text_column``; null texts stay null."""
    marked = _dropped(docs, least, least_length, batches, id_column, text_column)
    lines = F.split(F.col(text_column), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return marked.withColumn(text_column, F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(left)).select(docs.columns)
