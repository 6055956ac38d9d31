"""Exact top-k inner products of sparse rows through inverted indexes with bounds.

Rows that are alike become one class, and a class stands for its smallest ids. Classes are laid into blocks by their
heaviest term, so that a block's rows use similar terms. A task holds the inverted index of one block: a posting list and
the largest weight for each term, and the largest row length. A query is worked on from its rarest term on; as soon as
the lengths (Cauchy-Schwarz) or the largest weights of the remaining, frequent terms can't bring a row to the score to
beat any more, no further list is opened: only rows met so far whose partial sum comes near enough are finished from
their own cells.

A query first visits its own block, which gives the score to beat. Then it goes only to groups of blocks whose largest
weights allow that score; the table of these has a bounded number of groups. Blocks and queries meet in tiles of bounded
size, so no term, class or query set has to fit one task, however frequent it is.

Rows: (id long, idx array of int or long, val array<double>); a term occurs once in a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.operators.relational import pick, top_per_group
from wayfunnel.session import discard, written

DIGITS = 9          # scores closer than this are ties, broken by id
SLACK = 1e-8        # allowance of the bounds for rounding
BLOCK = 32768       # classes of a block, at most
TILE = 32768        # queries that meet a block in one task, at most
SLICE = 1 << 20     # cells of a block that are indexed at a time, about, which bounds a task's memory
SMALL = 1024        # rows that aren't worth a second tile
BUCKETS = 4096      # groups of heaviest terms that blocks are packed from
FEW_BLOCKS = 4      # so many are visited at once, as a first visit would be a large part of the work
GROUPS = 256        # groups of blocks whose largest weights are kept
FOLDED = 1 << 20    # terms that the table tells apart
BOUND_CELLS = 1 << 22  # the most cells of that table (16 MB), which is sent to all tasks


class Inverted:
    """The inverted index of a block; rows are in the order of their ids."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, idx: np.ndarray, val: np.ndarray, sizes: np.ndarray | None = None):
        self.ids, self.offsets, self.val, self.sizes = ids, offsets, val, sizes
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(idx, kind="stable")
        self.docs, self.weights = rows[order], val[order]
        self.terms, starts, self.cells = np.unique(idx[order], return_index=True, return_inverse=True)
        self.cells[order] = self.cells.copy()  # the place of each cell's term among all terms
        self.bounds = np.append(starts, len(idx))
        self.most = np.maximum.reduceat(np.abs(self.weights), starts) if len(starts) else np.zeros(0)
        squares = np.bincount(rows, val * val, len(ids))
        self.length = math.sqrt(squares.max()) if len(squares) else 0.0
        self.dense = np.zeros(len(self.terms))
        self.read = 0  # postings and cells so far

    def _read(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What some lists bring to every row."""
        if not len(lo):
            return np.zeros(len(self.ids))
        spans = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist())]
        docs, gains = np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans])
        gains *= np.repeat(weight, hi - lo)
        self.read += len(docs)
        return np.bincount(docs, gains, len(self.ids))

    def _finished(self, rows: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole products of some rows with a query, from the rows' own cells."""
        self.dense[place] = weight
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.val[at] * self.dense[self.cells[at]], len(rows))
        self.dense[place] = 0.0
        return out

    def jaccard(self, idx: np.ndarray, val: np.ndarray, least: float, size: float, common: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share ``common`` terms at least, and their shares of the terms of both, if that is ``least`` or more.

        Such a row shares at least that part of the larger set, so rows of other sizes needn't be counted out one by one.
        """
        rows, both = self.search(idx, val, max(common, least * size))
        scores = np.round(both / (size + self.sizes[rows] - both), DIGITS)
        kept = (scores >= least - SLACK) & (both >= common)
        return rows[kept], scores[kept]

    def search(self, idx: np.ndarray, val: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that reach ``least`` and their rounded products."""
        place = np.searchsorted(self.terms, idx)
        place[place == len(self.terms)] = 0
        here = self.terms[place] == idx if len(self.terms) else np.zeros(len(idx), bool)
        place, weight = place[here], val[here]
        lo, hi = self.bounds[place], self.bounds[place + 1]
        order = np.argsort(hi - lo, kind="stable")
        place, lo, hi, weight = place[order], lo[order], hi[order], weight[order]
        most = self.most[place]

        def still(x: np.ndarray) -> np.ndarray:
            """Sums over each term and all more frequent ones, and 0 at the end."""
            return np.append(np.cumsum(x[::-1])[::-1], 0.0)

        reach = np.minimum(np.sqrt(still(weight * weight)) * self.length, still(np.abs(weight) * most))
        needed = reach >= least - SLACK
        if not needed[0]:
            return np.zeros(0, np.int64), np.zeros(0)
        used = int(np.argmin(needed)) if not needed.all() else len(lo)
        sums = self._read(lo[:used], hi[:used], weight[:used])
        rows = np.flatnonzero(sums + reach[used] >= least - SLACK)
        ahead = int((hi[used:] - lo[used:]).sum())
        cells = int((self.offsets[rows + 1] - self.offsets[rows]).sum())
        if cells < ahead:
            scores = self._finished(rows, place, weight)
            self.read += cells
        else:  # the other lists are shorter than these rows
            scores = (sums + self._read(lo[used:], hi[used:], weight[used:]))[rows] if ahead else sums[rows]
        scores = np.round(scores, DIGITS)
        kept = scores >= least - SLACK
        return rows[kept], scores[kept]


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    idx, val = (table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in ("idx", "val"))
    offsets = idx.offsets.to_numpy().astype(np.int64)
    return table["id"].to_numpy(), offsets - offsets[0], idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy()


def keyed(points: DataFrame) -> DataFrame:
    """The rows with 128 bits that name what they hold, written once."""
    sized = points if "size" in points.columns else points.withColumn("size", F.lit(0))
    size = F.col("size").cast("long")
    return written(sized.select(F.col("id").cast("long").alias("id"), size.alias("size"), "idx", "val",
                                F.xxhash64("idx", "val", size).alias("h1"), F.xxhash64(F.lit(7), size, "val", "idx").alias("h2")), "sparse-rows")


def _named(rows: DataFrame) -> DataFrame:
    """Only ids and names of the rows, whose cells are kept by their classes."""
    names = written(rows.select("id", "h1", "h2"), "sparse-names")
    discard(rows)
    return names


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for all rows that are alike: ``id`` (the smallest), their number, cells, and the heaviest term."""
    grouped = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"),
                                           F.any_value("size").alias("size"), F.any_value("idx").alias("idx"), F.any_value("val").alias("val"))
    heaviest = F.get("idx", (F.array_position("val", F.array_max("val")) - 1).cast("int"))
    return grouped.withColumn("lead", F.pmod(F.coalesce(heaviest, F.lit(-1)), F.lit(BUCKETS)).cast("int"))


def packed(sizes: list[tuple[int, int]], room: int) -> list[tuple[int, int, int]]:
    """(bucket, first block, number of blocks): small buckets share a block, large ones are dealt out to several."""
    out, block, used = [], 0, 0
    for bucket, n in sizes:
        if n > room:
            block += used > 0
            parts = -(-n // room)
            out.append((bucket, block, parts))
            block, used = block + parts, 0
            continue
        if used + n > room:
            block, used = block + 1, 0
        out.append((bucket, block, 1))
        used += n
    return out


def side_of(rows: int, most: int, tasks: int) -> int:
    """Rows on one side of a tile: few tiles, as each row is sent once for each tile of its line, but one for every task."""
    return min(most, max(SMALL, math.ceil(rows / max(1, round(math.sqrt(tasks))))))


def _tile_search(asked: DataFrame, members: DataFrame, cells: DataFrame, k: int, min_score: float, strict: bool, common: float | None) -> DataFrame:
    """Queries (with ``block``, the block that they visit) against the blocks, in the tiles that ``cells`` names."""
    keys, most = ["block", "home", "part"], SLICE

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sources, targets, scores = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids, offsets, idx, val = _cells(left)
            sizes = left["size"].to_numpy()
            limits = np.maximum(left["least"].fill_null(-math.inf).to_numpy(), min_score)
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
            cells = pc.list_value_length(right["idx"]).to_numpy()
            starts = np.flatnonzero(np.diff((np.cumsum(cells) - cells) // most, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], right.num_rows]):  # by rising ids, so that earlier finds win ties
                some = right.slice(start, end - start)
                index = Inverted(*_cells(some), some["size"].to_numpy())
                for i in range(len(ids)):
                    a, b = offsets[i], offsets[i + 1]
                    rows, found = index.search(idx[a:b], val[a:b], limits[i]) if common is None \
                        else index.jaccard(idx[a:b], val[a:b], limits[i], sizes[i], common)
                    good = found > min_score if strict else found >= min_score
                    if not good.any():
                        continue
                    there, found = index.ids[rows[good]], found[good]
                    if best[i] is not None:
                        there, found = np.concatenate([best[i][0], there]), np.concatenate([best[i][1], found])
                    if len(there) > k:
                        cut = np.partition(found, len(found) - k)[len(found) - k]
                        there, found = there[found >= cut], found[found >= cut]
                        first = np.sort(np.argsort(-found, kind="stable")[:k])
                        there, found = there[first], found[first]
                    if len(there) == k:
                        limits[i] = max(limits[i], found.min())
                    best[i] = there, found
            for source, kept in zip(ids, best):
                if kept is not None:
                    sources.append(np.full(len(kept[0]), source))
                    targets.append(kept[0])
                    scores.append(kept[1])
        return pa.table([np.concatenate(x) if x else np.zeros(0, t) for x, t in ((sources, np.int64), (targets, np.int64), (scores, float))],
                        names=["src", "dst", "score"])

    there = members.select("block", "id", "size", "idx", "val").join(cells, "block")
    # both sides may stem from one table, so the right side's columns are its own
    right = there.select(*[F.col(c).alias(f"m_{c}") for c in keys], *[F.col(c).alias(c) for c in ("id", "size", "idx", "val")])
    return asked.select(*keys, "id", "size", "idx", "val", "least").groupBy(*keys) \
        .cogroup(right.groupBy(*[f"m_{c}" for c in keys])).applyInArrow(run, "src long, dst long, score double")


def _bounds(members: DataFrame, groups: int, blocks: int, width: int) -> np.ndarray:
    """The largest absolute weight of each term in each group of blocks: at most BOUND_CELLS cells, terms folded to ``width``."""
    group = F.floor(F.col("block") * groups / blocks).cast("int").alias("g")
    cells = members.select(group, F.explode(F.arrays_zip("idx", "val")).alias("c"))
    # 12 bytes a cell reach the driver, as Arrow: rows would take some hundred bytes each there
    rows = cells.groupBy("g", F.pmod("c.idx", F.lit(width)).cast("int").alias("t")).agg(F.max(F.abs("c.val")).cast("float").alias("w")).toArrow()
    out = np.zeros((groups, width), np.float32)
    out[rows["g"].to_numpy(), rows["t"].to_numpy()] = np.nextafter(rows["w"].to_numpy(), np.float32(np.inf))
    return out


def sparse_topk(points: DataFrame, k: int, min_score: float = -math.inf, strict: bool = False,
                queries: DataFrame | None = None, exclude_self: bool = True, block: int = BLOCK, common: float | None = None) -> DataFrame:
    """(src, dst, score, rank): the ``k`` rows with the largest inner products for each query, by score, then id.

    Scores below ``min_score`` (``strict``: and at it) are left out. Ids are unique within a table. With ``common`` the rows
    are sets (all weights 1) with a ``size`` that may count further members, and the score of rows with at least so many
    shared terms is these by the members of both.
    """
    spark = points.sparkSession
    wanted = k + 1 if exclude_self else k
    rows = keyed(points)
    classes = written(classes_of(rows), "sparse-classes")
    sizes = sorted((r["lead"], r["n"]) for r in classes.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).collect())  # at most BUCKETS rows
    if not sizes:
        return spark.createDataFrame([], "src long, dst long, score double, rank int")
    tasks, total = spark.sparkContext.defaultParallelism, sum(n for _, n in sizes)
    plan = packed(sizes, side_of(total, block, tasks))
    blocks = plan[-1][1] + plan[-1][2]
    # a query whose heaviest term leads no block goes to the first one
    homes = {bucket: (first, parts) for bucket, first, parts in plan}
    layout = F.broadcast(spark.createDataFrame([(b, *homes.get(b, (0, 1))) for b in range(BUCKETS)], "lead int, first int, parts int"))

    def placed(df: DataFrame, name: str) -> DataFrame:
        return df.join(layout, "lead").withColumn(name, (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")) \
            .select("id", "n", "size", "idx", "val", "h1", "h2", name)

    members = placed(classes, "block")
    asking = rows if queries is None else keyed(queries)
    source = classes if queries is None else written(classes_of(asking), "sparse-queries")
    rows = _named(rows)
    asking = rows if queries is None else _named(asking)
    asked = placed(source, "home")
    tile = side_of(total if queries is None else source.count(), TILE, tasks)
    loads = asked.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts")).collect()  # a row for each block
    parts = F.broadcast(spark.createDataFrame([(r["home"], r["parts"]) for r in loads], "home int, parts int"))
    asked = asked.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    if blocks <= FEW_BLOCKS:
        every = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "least": F.lit(None).cast("double")})
        found = _tile_search(every, members, every.select("block", "home", "part").distinct(), wanted, min_score, strict, common)
    else:
        own = asked.withColumns({"block": F.col("home"), "least": F.lit(None).cast("double")})
        found = written(_tile_search(own, members, own.select("block", "home", "part").distinct(), wanted, min_score, strict, common), "sparse-first")
        reached = found.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= wanted, F.min("score")).alias("least"))
        known = asked.join(reached, "id", "left")
        need = F.coalesce("least", F.lit(min_score))
        if common is not None:
            need = F.greatest(need * F.col("size"), F.lit(float(common)))
        visits = written(_visits(known.withColumn("least", need), members, blocks, min_score if common is None else 0.0).filter("block <> home"), "sparse-visits")
        # a row for each query and block, which its file holds in less than a byte: by the file's size Spark would broadcast it
        second = _tile_search(known.join(visits.select("id", "block").hint("shuffle_merge"), "id"), members,
                              visits.select("block", "home", "part").distinct(), wanted, min_score, strict, common)
        found = found.unionByName(second)
    found = written(found, "sparse-found")
    return _expanded(pick(found, ["src"], [F.desc("score"), F.asc("dst")], wanted), rows, classes, asking, source, k, exclude_self)


def _visits(asked: DataFrame, members: DataFrame, blocks: int, min_score: float) -> DataFrame:
    """(id, home, part, block) for the blocks whose largest weights allow a query's score to beat."""
    largest = members.agg(F.max(F.greatest(F.array_max("idx"), -F.array_min("idx")))).first()[0]
    width = min(FOLDED, int(largest or 0) + 1)
    groups = max(1, min(GROUPS, blocks, BOUND_CELLS // width))
    bounds = members.sparkSession.sparkContext.broadcast(_bounds(members, groups, blocks, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets, idx, val = _cells(pa.Table.from_batches([batch]))
            least = np.maximum(batch.column(batch.schema.get_field_index("least")).fill_null(-math.inf).to_numpy(zero_copy_only=False), min_score)
            at, to = [], []
            for i in range(len(ids)):
                terms, weights = idx[offsets[i]:offsets[i + 1]], np.abs(val[offsets[i]:offsets[i + 1]])
                most = bounds.value[:, terms % width] @ weights
                good = np.flatnonzero(most >= least[i] - SLACK)
                at.append(np.full(len(good), i))
                to.append(good)
            rows = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("id", "home", "part")]
                                             + [pa.array(np.concatenate(to) if to else np.zeros(0, np.int64), pa.int64())],
                                             names=["id", "home", "part", "g"])

    to_groups = asked.select("id", "home", "part", "idx", "val", "least").mapInArrow(run, "id long, home int, part int, g long")
    of_group = members.select(F.floor(F.col("block") * groups / blocks).alias("g"), "block").distinct()
    return to_groups.join(of_group, "g").select("id", "home", "part", "block")


def _expanded(best: DataFrame, points: DataFrame, classes: DataFrame, asking: DataFrame, source: DataFrame, k: int,
              exclude_self: bool) -> DataFrame:
    """From classes to rows: each class stands for its smallest ids, each query class for all its queries."""
    def members_of(df: DataFrame, of: DataFrame) -> DataFrame:
        return df.select("id", "h1", "h2").join(of.filter("n > 1").select("h1", "h2", F.col("id").alias("class")), ["h1", "h2"]).select("class", "id")

    wanted = k + 1 if exclude_self else k
    smallest = pick(members_of(points, classes), ["class"], [F.asc("id")], wanted).groupBy("class").agg(F.collect_list("id").alias("ids"))
    rows = best.withColumnRenamed("dst", "class").join(smallest, "class", "left") \
        .select("src", F.explode(F.coalesce("ids", F.array("class"))).alias("dst"), "score")
    rows = pick(rows, ["src"], [F.desc("score"), F.asc("dst")], wanted)
    single = source.filter("n = 1").select(F.col("id").alias("class"), "id")
    named = single.unionByName(members_of(asking, source))
    answer = rows.withColumnRenamed("src", "class").join(named, "class").select(F.col("id").alias("src"), "dst", "score")
    answer = answer.filter("src <> dst") if exclude_self else answer
    return top_per_group(answer, ["src"], [F.desc("score"), F.asc("dst")], k)
