"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.adapters import Inputs
from wayfunnel.plans.oracle import with_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, counts to long: one stable output schema."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # the small shift decides exact ties the same way in both engines; + 0.0 clears negative zeros
            c = F.round(c.cast("double") + F.lit(1.3e-10), DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Callable]:
    """Register ``fn(Inputs) -> DataFrame``; ``oracle`` is SQL over the given tables."""
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Inputs(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_tables(oracle)
        return fn
    return register
