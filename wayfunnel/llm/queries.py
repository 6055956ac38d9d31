"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfunnel.llm import bpe, debruijn, forest, impact, lexical, licenses, lines, oracles, packing, permutation, substrings, tiling, toxicity, turns

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return permutation.neighbours(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query(oracles.COMMON_LINES)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least ten documents hold."""
    return lines.common_lines(table(spark, sf_dir, "documents"), 10, kept=False)


@query()
def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids packed into rows of 2048, as digests."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 2048, binary=False)


@query()
def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids and decoded text."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False)


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that start at another place as well."""
    return substrings.without_repeats(table(spark, sf_dir, "documents"), 400, kept=False)


@query(oracles.NEAR_DUPLICATES)
def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates on two-word shingles."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license labels."""
    return licenses.scan(table(spark, sf_dir, "documents"), spans=False)


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of held-out documents are not learned from."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(oracles.WORD_WINDOWS)
def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that start at another place as well."""
    return debruijn.without_repeats(table(spark, sf_dir, "documents"), 35, kept=False)


@query()
def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it leaks."""
    return tiling.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(oracles.CONVERSATION_REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after planted damage, and its cheapest repair."""
    return turns.repaired_conversations(table(spark, sf_dir, "conversations"))


@query(oracles.IMPACT_SEARCH)
def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest integer inner products for every twentieth vector, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return impact.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query(oracles.LEXICAL_SEARCH)
def op13_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents with the highest scores for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
