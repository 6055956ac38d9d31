"""Ranked lexical search, exact: short posting lists are summed first, long ones are skipped through.

A first pass counts every document's terms and keeps those that a query uses (its bag), a second one scores bags. A task
takes its bags block by block and builds the block's posting lists. For each query the shortest lists are summed term at
a time into accumulators. These then act as one more list, ordered by document and bounded by their largest sum, beside
the long lists, each bounded by its largest score. All of them are read document at a time: lists whose bounds together
stay below the k-th best score so far can't bring a document in by themselves, so only documents of the other lists are
looked at, and the skipped lists are searched for just those that can still get in, until their bounds rule them out.

Blocks don't move between tasks; a task returns the k best documents of each query, whatever it has read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.llm._tables import Scratch, union
from wayfunnel.llm._text import lean
from wayfunnel.operators.relational import top_per_group

# Characters of a term, and the weights of the score (length share in percent, saturation, scale).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH, SATURATION, SCALE = 90, 8, 1_000_000_000

PIECE = 1 << 20  # bytes of a text that are split at a time
BATCH_TERMS = 200_000  # terms of the queries that are sent to the tasks at a time
WINDOW = 1024  # documents between two looks at the score to beat
_GAPS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
NO_ID = np.iinfo(np.int64).min  # a null id, which comes first


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about a megabyte, cut between terms."""
    lo = 0
    while lo < len(text):
        cut = _GAP.search(text, lo + PIECE)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def bag(text: bytes, known: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of terms of a text, and how often each known one occurs."""
    count, tally = 0, Counter()
    for piece in pieces(text):
        terms = piece.lower().translate(_GAPS).split()
        count += len(terms)
        tally.update(map(known.get, terms, repeat(-1)))
    tally.pop(-1, None)
    return count, tally


class Best:
    """The k best documents of a query so far, best first; ``least`` is what a further one has to reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


class Block:
    """Posting lists of some documents: for each term the documents in order, their scores, and the largest of these."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        own = np.repeat(np.arange(len(ids)), sizes)
        scores = weights[terms] * (SCALE * counts // (1000 * counts + SATURATION * norms[own]))
        order = np.argsort(terms, kind="stable")
        self.ids, self.docs, self.scores = ids, own[order], scores[order]
        terms = terms[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        self.lists = dict(zip(terms[starts].tolist(), zip(starts.tolist(), np.append(starts[1:], len(terms)).tolist(),
                                                         np.maximum.reduceat(self.scores, starts).tolist() if len(starts) else [])))

    def _accumulated(self, short: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
        """The sums over the short lists, as one list."""
        docs = np.concatenate([self.docs[lo:hi] for lo, hi, _ in short])
        scores = np.concatenate([self.scores[lo:hi] for lo, hi, _ in short])
        order = np.argsort(docs, kind="stable")
        docs, scores = docs[order], scores[order]
        starts = np.flatnonzero(np.diff(docs, prepend=-1))
        sums = np.add.reduceat(scores, starts)
        return docs[starts], sums, int(sums.max())

    def search(self, terms: list[int], best: Best) -> None:
        """Put the block's documents that belong there among the ``best`` of the query that has these terms."""
        found = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: x[1] - x[0])
        if not found:
            return
        room, short = max(WINDOW, len(self.ids) // 4), 0
        while short < len(found) and room >= found[short][1] - found[short][0]:
            room -= found[short][1] - found[short][0]
            short += 1
        lists = [(self.docs[lo:hi], self.scores[lo:hi], most) for lo, hi, most in found[short:]]
        if short:
            lists.append(self._accumulated(found[:short]))
        lists.sort(key=lambda x: x[2])
        reach = np.cumsum([x[2] for x in lists])  # the most that the first lists bring together
        for lo in range(0, len(self.ids), WINDOW):
            skipped = int(np.searchsorted(reach, best.least))  # lists that don't reach the score to beat
            if skipped == len(lists):
                return
            leading = []
            for docs, scores, _ in lists[skipped:]:
                a, b = np.searchsorted(docs, (lo, lo + WINDOW))
                if a < b:
                    leading.append((docs[a:b], scores[a:b]))
            if not leading:
                continue
            sums, held = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
            for docs, scores in leading:
                sums[docs - lo] += scores
                held[docs - lo] = True
            at = np.flatnonzero(held)
            docs, sums = at + lo, sums[at]
            for k in range(skipped - 1, -1, -1):
                alive = sums + reach[k] >= best.least
                docs, sums = docs[alive], sums[alive]
                if not len(docs):
                    break
                listed, scores, _ = lists[k]
                place = np.searchsorted(listed, docs)
                place[place == len(listed)] = 0
                sums = sums + np.where(listed[place] == docs, scores[place], 0)
            alive = sums >= best.least
            if alive.any():
                best.add(sums[alive], self.ids[docs[alive]])


def _bags(documents: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``id``, the number of terms ``n``, and of the known terms ``terms`` and ``counts``, for every document."""
    known = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.large_string()).cast(pa.large_binary()):
                count, tally = bag(text.as_py() or b"", known.value)
                numbers.append(count)
                terms.extend(tally.keys())
                counts.extend(tally.values())
                sizes.append(len(terms))
            sizes = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(sizes, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(sizes, pa.array(counts, pa.int64()))], names=["id", "n", "terms", "counts"])

    return documents.mapInArrow(lean(run), "id long, n long, terms array<int>, counts array<long>")


def _ranked(bags: DataFrame, items: list[list[int]], weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """The ``k`` best documents of each item that a task has seen: ``at`` (place in ``items``), ``id``, ``score``."""
    shared = bags.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lengths = batch.column(1).to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            block = Block(ids, 100 - LENGTH + LENGTH * lengths * total // max(length, 1), sizes,
                          batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), weights)
            for terms, top in zip(items, best, strict=True):
                block.search(terms, top)
        at = np.repeat(np.arange(len(items), dtype=np.int32), [len(b.ids) for b in best])
        if len(at):
            ids, scores = np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["at", "id", "score"])

    return bags.mapInArrow(lean(run), "at int, id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 10, *, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: the item column, ``rank`` from 1, the id column, ``score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Rows with a
    null, empty or blank text hold no term: such documents aren't counted and such items have no results. Equal scores go
    by ascending id (integers; a null id first, as in Spark's ascending order). Rows of ``documents`` that are alike are
    ranked each for itself. Of items with one id the least text counts. Other columns are ignored. Queries are worked
    on in batches of a bounded number of terms, which alone are sent to tasks.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "lexical")
    kind = items.schema[item_column].dataType.simpleString()
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate(F.col("text"), upper, upper.lower())
    queries = scratch.table(items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).groupBy("item")
                            .agg(F.min("text").alias("text"))
                            .select("item", F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"))
                            .filter(F.size("terms") > 0))
    batches = -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // BATCH_TERMS)
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    parts = []
    for batch in range(batches):
        rows = queries.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == batch).collect()  # about BATCH_TERMS terms
        known = {t: i for i, t in enumerate(sorted({t for row in rows for t in row.terms}))}
        bags = scratch.table(_bags(texts, {t.encode(): i for t, i in known.items()}))
        total, length = bags.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = bags.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.zeros(len(known), np.int64)
        for row in held.select("term", F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("count") + 1))).alias("w")).collect():
            weights[row.term] = row.w
        names = spark.createDataFrame([(i, row.item) for i, row in enumerate(rows)], f"at int, item {kind}")
        found = _ranked(bags, [[known[t] for t in row.terms] for row in rows], weights, total, length, k)
        parts.append(found.join(F.broadcast(names), "at"))
    if not parts:
        return spark.createDataFrame([], f"{item_column} {kind}, rank int, {id_column} long, score long")
    best = top_per_group(union(parts), ["item"], [F.desc("score"), F.asc("id")], k)
    return best.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
