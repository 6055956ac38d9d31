"""Windows of a sequence that occur more than once, found through content-chosen anchors.

Every window of ``width`` units holds ``width - seed + 1`` seeds; the one with the smallest fingerprint, leftmost in
ties, is its anchor. Equal windows have equal anchors at equal places, so a window whose anchor's seed occurs once
cannot repeat. Consecutive windows with one anchor form a stretch: a few per hundred units. A stretch whose whole
block occurs again repeats as a whole. Where a seed has different blocks, one stretch of each block is cut into parts of a
few windows, placed by their distance to the anchor; a part's seed is what all its windows hold, its block what they
hold together, and the same rule decides. Parts of one window are decided by their count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.llm._tables import Bits, Scratch, union
from wayfunnel.llm._text import Prints, lean

_PLACE = np.uint64((1 << 24) - 1)
PIECE = 1 << 18

PARTS = "seed long, block long, _r1 long, _r2 long, first int, windows int"
NAMES = [x.split()[0] for x in PARTS.split(", ")]
KEYS = ["_r1", "_r2"]
SHORT = (1 << 40) - 1  # counting needs no more bits of a seed: a clash lets a row through to the exact step


class Piece(NamedTuple):
    """Units of some rows with their stretches: places count from the piece's start."""

    prints: Prints
    keys: list[np.ndarray]  # of all rows of the batch
    row: int  # first row of the piece
    offsets: np.ndarray  # of the rows within
    base: int  # units of the first row before the piece
    at: np.ndarray  # row of each stretch, from ``row``
    first: np.ndarray
    count: np.ndarray
    seeds: np.ndarray
    blocks: np.ndarray
    anchors: np.ndarray


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[Piece]]


def pieces(offsets: np.ndarray, width: int, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
    """Cut sequences into pieces of at most ``limit`` units: start, end, offsets within, first sequence, place in it.

    A sequence over the limit becomes overlapping pieces, so that each of its windows lies in exactly one.
    """
    lo, count = 0, len(offsets) - 1
    limit = max(limit, 2 * width)
    while lo < count:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= limit:
            yield a, b, offsets[lo:hi + 1] - a, lo, 0
        else:
            for at in range(a, max(a + 1, b - width + 1), limit - width + 1):
                end = min(b, at + limit)
                yield at, end, np.array([0, end - at]), lo, at - a
        lo = hi


def stretches(prints: Prints, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each stretch: sequence, first window, number of windows, prints of seed and block, place of the anchor."""
    units, span = len(prints.sums) - 1, width - seed + 1
    long = np.diff(offsets) >= width
    if not long.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    seeds = prints.every(seed)
    least = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[:step - span], least[span - step:])
    edge = np.zeros(units + 1, np.int32)
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - width + 1] -= 1
    places = np.flatnonzero(np.cumsum(edge)[:len(least)])
    anchors = (least[places] & _PLACE).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    first, count, anchors = places[begins], np.diff(np.r_[begins, len(places)]), anchors[begins]
    return (np.searchsorted(offsets, first, side="right") - 1, first, count, seeds[anchors],
            prints.of(first, first + count - 1 + width), anchors)


def _cut(piece: Piece, width: int, size: int) -> Piece:
    """The stretches of a piece in parts of ``size`` windows by distance to the anchor."""
    far, near = (piece.anchors - piece.first) // size, (piece.anchors - piece.first - piece.count + 1) // size
    number = far - near + 1
    group = np.repeat(far, number) - (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
    at, first, count, anchors = (np.repeat(x, number) for x in (piece.at, piece.first, piece.count, piece.anchors))
    low = np.maximum(first, anchors - group * size - size + 1)
    high = np.minimum(first + count - 1, anchors - group * size)
    inner = anchors - group * size
    return piece._replace(at=at, first=low, count=high - low + 1, anchors=anchors,
                          seeds=piece.prints.of(inner, inner - size + 1 + width), blocks=piece.prints.of(low, high + width))


_STEP = 2654435761


def _codes(piece: Piece) -> np.ndarray:
    """A code of each part's row and first window, for filters; ``_code`` gives the same in SQL."""
    place = (piece.first - piece.offsets[piece.at] + piece.base).astype(np.int64)
    return piece.keys[0][piece.row + piece.at] ^ (place * _STEP)


def _code(row: Column, first: Column) -> Column:
    return row.bitwiseXOR(first.cast("long") * F.lit(_STEP))


def _only(piece: Piece, hit: np.ndarray) -> Piece:
    return piece._replace(**{n: getattr(piece, n)[hit] for n in ("at", "first", "count", "seeds", "blocks", "anchors")})


class Step(NamedTuple):
    """Cut to parts of ``size`` windows (0: no cut) and keep those whose code or seed passes a filter."""

    size: int
    codes: Bits | None = None
    seeds: Bits | None = None


def parts(keyed: DataFrame, scan: Scan, width: int, steps: list[Step] | None = None) -> DataFrame:
    """Stretches of all rows, or their parts after some steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in scan(batches):
            for step in steps or []:
                piece = _cut(piece, width, step.size) if step.size else piece
                piece = _only(piece, step.codes.has(_codes(piece))) if step.codes else piece
                piece = _only(piece, step.seeds.has(piece.seeds)) if step.seeds else piece
            row = piece.row + piece.at
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                piece.seeds.view(np.int64), piece.blocks.view(np.int64), piece.keys[0][row], piece.keys[1][row],
                (piece.first - piece.offsets[piece.at] + piece.base).astype(np.int32), piece.count.astype(np.int32))], names=NAMES)

    return keyed.select(*KEYS, "text").mapInArrow(lean(run), PARTS)


def filtered(rows: DataFrame, bits: Bits, column: int = 0) -> DataFrame:
    """Rows whose column at that place, the first one if not told, passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.has(batch.column(column).to_numpy())))

    return rows.mapInArrow(lean(run), rows.schema)


def repeated_seeds(rows: DataFrame) -> DataFrame:
    """Short seeds met at least twice."""
    return (rows.select(F.col("seed").bitwiseAND(F.lit(SHORT)).alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
            .filter("n >= 2").select("seed"))


def _decided(scratch: Scratch, rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of the parts whose block is met again, and the codes of one part for each block of a seed with several.

    What is joined is a table first, so that both sides are plain exchanges and a frequent block is split.
    """
    blocks = scratch.table(rows.groupBy("seed", "block").agg(F.count("*").alias("n"), F.min(_code(F.col("_r1"), F.col("first"))).alias("code")))
    whole = rows.join(blocks.filter("n > 1").select("seed", "block"), ["seed", "block"]).select(
        *KEYS, F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + width).alias("stop"))
    several = scratch.table(blocks.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"))
    return whole, blocks.join(several, "seed").select("code")


def covered(scratch: Scratch, keyed: DataFrame, found: DataFrame, repeated: DataFrame, scan: Scan, width: int,
            sizes: tuple[int, ...]) -> DataFrame:
    """Ranges of units covered by repeated windows: ``_r1``, ``_r2`` and ``ranges``, an array of (start, stop); a table.

    ``found``: the stretches, as a table; ``repeated``: their seeds met twice; ``sizes``: windows in a part, step by
    step, the last 1. A row's array is bounded by its own text.
    """
    rows = scratch.table(filtered(found, Bits(repeated)))
    ranges, steps = [], []
    for size in (0, *sizes):
        if size:
            seeds = None
            if size == 1:  # many rows, most met once: their seeds are counted first
                seeds = Bits(repeated_seeds(parts(keyed, scan, width, [*steps, Step(size)])))
            rows = scratch.table(parts(keyed, scan, width, [*steps, Step(size, seeds=seeds)]))
        whole, codes = _decided(scratch, rows, width)
        ranges.append(whole)
        if size != sizes[-1]:
            steps.append(Step(size, codes=Bits(codes)))
    return scratch.table(union(ranges).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))


def finished(keyed: DataFrame, ranges: DataFrame, cut: Callable, schema: T.StructType) -> DataFrame:
    """``cut`` for every row, over batches of id, text and ranges; only texts that may have ranges are shuffled."""
    bits = Bits(ranges.select("_r1"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = batch.filter(pa.array(~bits.has(batch.column(0).to_numpy()))).select([1, 2])
                yield part.append_column("ranges", pa.nulls(part.num_rows))
        return cut(left())

    touched = filtered(keyed.select("_r1", "_r2", "_id", "text"), bits).join(ranges, KEYS, "left")
    return (keyed.select("_r1", "_id", "text").mapInArrow(lean(without), schema)
            .unionByName(touched.select("_id", "text", "ranges").mapInArrow(lean(cut), schema)))


def merged(ranges: list | None) -> np.ndarray:
    """Sorted disjoint ranges from overlapping or touching ones; two columns."""
    if not ranges:
        return np.zeros((0, 2), np.int64)
    x = np.array([(r["start"], r["stop"]) for r in ranges], np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.r_[True, x[1:, 0] > reach[:-1]]
    return np.column_stack([x[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]]])
