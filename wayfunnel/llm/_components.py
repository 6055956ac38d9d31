"""Connected components of an edge table by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.llm._tables import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for every id in ``edges`` (``a``, ``b``: long).

    Each round links every id's smallest neighbour to all its larger ones and drops what it has linked (the
    alternating large-star and small-star steps of Kiveris et al.), so that chains halve; it ends when every edge
    leads straight to its component. Sums are made before the shuffle, so a hub needs no group of its own.
    """
    links = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large)
        # small star: smaller neighbours and the id itself go to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        small = scratch.table(small)
        # done when no id has two parents and no parent has one
        twice = small.groupBy("a").count().filter("count > 1").select("a")
        chained = small.select("a").join(small.select(F.col("b").alias("a")), "a", "left_semi")
        links = small
        if twice.unionByName(chained).isEmpty():
            break
    roots = links.select(F.col("b").alias("id")).distinct()
    return scratch.table(links.select(F.col("a").alias("id"), F.col("b").alias("component"))
                         .unionByName(roots.select("id", F.col("id").alias("component"))))
