"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents share seeds: windows of ``seed`` words, found by rolling Karp-Rabin prints. For a document
and an item with common seeds the longest match is marked again and again, both sides' words once at most, until no
match of ``seed`` words is left. The share of the item's words under such tiles tells a leak, in whatever order its
passages stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.llm._tables import Bits, Scratch
from wayfunnel.llm._text import Prints, lean, lowered, row_key, slices, terms, utf8
from wayfunnel.llm.debruijn import word_codes

SEED = 5
COVERAGE = 0.5


def tiles(places: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (first word there, first word here, length) from the places of all common seeds.

    Seeds on one diagonal without a gap are one match; the longest match goes first, of equal ones the one that starts
    earliest in the first text, then in the second.
    """
    runs: list[tuple[int, int, int]] = []
    for a, b in sorted(set(places), key=lambda x: (x[0] - x[1], x[0])):
        if runs and runs[-1][0] - runs[-1][1] == a - b and runs[-1][0] + runs[-1][2] == a:
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((a, b, 1))
    heap = [(-(n + seed - 1), a, b) for a, b, n in runs]
    heapq.heapify(heap)
    marked_a: set[int] = set()
    marked_b: set[int] = set()
    out = []
    while heap:
        length, a, b = heapq.heappop(heap)
        free = [a + i not in marked_a and b + i not in marked_b for i in range(-length)] + [False]
        if all(free[:-1]):
            out.append((a, b, -length))
            marked_a.update(range(a, a - length))
            marked_b.update(range(b, b - length))
            continue
        start = None
        for i, x in enumerate(free):
            if x and start is None:
                start = i
            elif not x and start is not None:
                if i - start >= seed:
                    heapq.heappush(heap, (start - i, a + start, b + start))
                start = None
    return out


def _seeds(keyed: DataFrame, seed: int, bits: Bits | None = None) -> DataFrame:
    """Seeds of all texts with their places and, for items, the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for lo, hi in slices(offsets, 1 << 18):
                part = lowered(data[offsets[lo]:offsets[hi]])
                starts, ends, firsts = terms(part, offsets[lo:hi + 1] - offsets[lo])
                prints = Prints(word_codes(part, starts, ends)).every(seed)
                count = np.diff(firsts)
                row = np.repeat(np.arange(hi - lo), count)[:len(prints)]
                place = np.arange(len(prints)) - firsts[:-1][row]
                fits = place + seed <= count[row]
                if bits is not None:
                    fits &= bits.has(prints)
                row, place = row[fits], place[fits]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    prints[fits].view(np.int64), keys[0][lo + row], keys[1][lo + row], place.astype(np.int32), count[row].astype(np.int32))],
                    names=["seed", "_r1", "_r2", "place", "words"])

    return keyed.select("_r1", "_r2", "text").mapInArrow(lean(run), "seed long, _r1 long, _r2 long, place int, words int")


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, *, id_column: str = "doc_id",
          text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Pairs of a row of ``docs`` and an item whose words it covers to ``coverage``: ``_r1``, ``_r2``, item id, ``covered``.

    Words are letters and digits, A-Z lower-cased. Items of under ``seed`` words cannot be told from chance and are in
    no pair; null texts have no words; repeated rows and items are one row each here. ``docs`` must be a stable plan.
    """
    scratch = Scratch(docs.sparkSession, "tiling")
    items = benchmark.select(F.col(item_column).alias("_item"), F.col(item_text_column).alias("text"),
                             *row_key(benchmark, item_column, item_text_column))
    there = (_seeds(items, seed).distinct().join(items.select("_item", "_r1", "_r2").distinct(), ["_r1", "_r2"])
             .select("seed", "_item", F.col("_r1").alias("item"), F.col("place").alias("there"), F.col("words").alias("words_there")))
    there = scratch.table(there)
    keyed = docs.select(F.col(text_column).alias("text"), *row_key(docs, id_column, text_column))
    here = _seeds(keyed, seed, Bits(there.select("seed"))).select("seed", "_r1", "_r2", F.col("place").alias("here"))
    common = (here.join(there, "seed").groupBy("_r1", "_r2", "item")
              .agg(F.first("_item").alias("_item"), F.first("words_there").alias("words"),
                   F.collect_set(F.struct("here", "there")).alias("places"))
              # each seed can add as many words as a tile has, so fewer seeds cannot reach the coverage
              .filter(F.size("places") * seed >= coverage * F.col("words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [sum(t[2] for t in tiles([(p["here"], p["there"]) for p in places], seed)) / words
                      for words, places in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            kept = batch.select([0, 1, 2]).append_column("covered", pa.array(shares, pa.float64()))
            yield kept.filter(pa.array([s >= coverage for s in shares], pa.bool_()))

    kind = benchmark.schema[item_column].dataType.simpleString()
    return (common.select("_r1", "_r2", "_item", "words", "places")
            .mapInArrow(lean(run), f"_r1 long, _r2 long, _item {kind}, covered double").withColumnRenamed("_item", item_column))


def marked(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, *, id_column: str = "doc_id",
           text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """For each row of ``docs``: the id, ``contaminated``, ``n_items``, ``best_item`` and ``best_covered``.

    The best item has the largest share, of equal ones the smallest id; both are null without a leak.
    """
    found = (leaks(docs, benchmark, seed, coverage, id_column=id_column, text_column=text_column, item_column=item_column)
             .groupBy("_r1", "_r2").agg(F.countDistinct(item_column).alias("n_items"),
                                        F.min(F.struct((-F.col("covered")).alias("s"), F.col(item_column).alias("i"))).alias("best")))
    rows = docs.select(F.col(id_column), *row_key(docs, id_column, text_column))
    return rows.join(found, ["_r1", "_r2"], "left").select(
        id_column, F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.col("best.i").alias("best_item"), (-F.col("best.s")).alias("best_covered"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, *,
                  id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The rows of ``docs``, with their columns, that leak no item."""
    found = leaks(docs, benchmark, seed, coverage, id_column=id_column, text_column=text_column, item_column=item_column)
    found = found.select("_r1", "_r2").distinct()
    names = [f"_key{i}" for i in (1, 2)]
    keyed = docs.withColumns(dict(zip(names, row_key(docs, id_column, text_column), strict=True)))
    return (keyed.join(found.toDF(*names), names, "left_anti").select(docs.columns))
