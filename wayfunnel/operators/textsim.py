"""TF-IDF vectors from a token table.

Weights: raw term count times ln((1 + docs) / (1 + docs with term)) + 1, rows
scaled to length 1; vocabulary = the most frequent terms over the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfunnel.session import written

# A token is two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
VOCABULARY = 5000


def tokens(text: Column | str, ngrams: int = 1, stop_words: Sequence[str] = ()) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if stop_words:
        words = F.array_except(words, F.array(*[F.lit(w) for w in stop_words])) if ngrams == 0 else \
            F.filter(words, lambda w: ~w.isin(list(stop_words)))
    if ngrams < 2:
        return words
    shifted = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(words, shifted, lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))),
                     lambda p: p.isNotNull())
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, key: str, text: str, ngrams: int = 1, stop_words: Sequence[str] = ()) -> DataFrame:
    """(id, term, tf); counted map-side, so a long document is reduced before it moves."""
    exploded = docs.select(F.col(key).alias("id"), F.explode(tokens(text, ngrams, stop_words)).alias("term"))
    return exploded.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: Column, size: int = VOCABULARY, min_df: int = 1,
               max_df: float = 1.0) -> DataFrame:
    """Top terms by corpus count, then by term: (term, index, idf), at most ``size`` rows."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = terms.withColumn("_n", n_docs).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    top = kept.orderBy(F.desc("total"), F.asc("term")).limit(size)
    w = Window.orderBy("term")  # at most ``size`` rows
    return top.select("term", (F.row_number().over(w) - 1).alias("index"),
                      (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted_rows(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, idx, val): sparse unit vectors. The vocabulary is bounded, so it is broadcast and a
    row gathers at most that many cells."""
    cells = counts.join(F.broadcast(vocab), "term").select("id", "index", (F.col("tf") * F.col("idf")).alias("w"))
    rows = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("index", "w"))).alias("cells"),
                                   F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return rows.filter("length > 0").select(
        F.col("id").cast("long").alias("id"), F.transform("cells", lambda c: c["index"]).alias("idx"),
        F.transform("cells", lambda c: c["w"] / F.col("length")).alias("val"))


def tfidf(docs: DataFrame, key: str, text: str, ngrams: int = 1, size: int = VOCABULARY, min_df: int = 1,
          max_df: float = 1.0, stop_words: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of the documents and the vocabulary that made them."""
    counts = written(term_counts(docs, key, text, ngrams, stop_words), "term-counts")  # read for the vocabulary and for the rows
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocab = vocabulary(counts, n_docs, size, min_df, max_df)
    return weighted_rows(counts, vocab), vocab
