"""Document frequencies, pruned vocabularies and bags of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.lookup import join_terms
from docspark.operators.numbering import number_rows
from docspark.session import materialize

# Fixed values of the pruning: least documents, greatest share of documents, terms kept.
MIN_DOCUMENTS = 30
MAX_SHARE = 0.5
KEEP_TERMS = 100_000
# Fixed value of the original vectors: least occurrences of a term in all documents together.
MIN_COUNT = 3


def document_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``term, df``: in how many documents each term occurs."""
    return (
        docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    )


def frequent_terms(docs: DataFrame, tokens: str = "tokens", min_count: int = MIN_COUNT) -> DataFrame:
    """``term, df`` of the terms that occur ``min_count`` times or more, be it in one document or in all of them."""
    each = lambda column, df, n: docs.select(F.explode(column).alias("term"), F.lit(df).alias("_df"), F.lit(n).alias("_n"))
    both = each(F.array_distinct(tokens), 1, 0).unionAll(each(F.col(tokens), 0, 1)).where(F.col("term").isNotNull())
    return both.groupBy("term").agg(F.sum("_df").alias("df"), F.sum("_n").alias("_n")).where(F.col("_n") >= min_count).drop("_n")


def top_terms(frequencies: DataFrame, keep: int = KEEP_TERMS) -> DataFrame:
    """The ``keep`` terms of highest document frequency, ties by term."""
    return frequencies.orderBy(F.desc("df"), "term").limit(keep)


def prune_terms(
    frequencies: DataFrame,
    n_docs: int,
    min_docs: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    keep: int | None = None,
) -> DataFrame:
    """Terms in at least ``min_docs`` and at most ``max_share`` of the documents; the top ``keep``, or all."""
    within = frequencies.filter((F.col("df") >= min_docs) & (F.col("df") <= max_share * F.lit(n_docs)))
    return within if keep is None else top_terms(within, keep)


def number_terms(terms: DataFrame, first_id: int = 0) -> DataFrame:
    """``term_id, term, df`` with ids by falling frequency, ties by term; the terms are counted once and written."""
    terms = materialize(terms.select("term", "df"), "frequencies")
    numbered = number_rows(terms, [F.desc("df"), F.asc("term")], "term_id")
    return numbered.select((F.col("term_id") + first_id).alias("term_id"), "term", "df")


def bag_of_words(docs: DataFrame, terms: DataFrame, *keys: str, tokens: str = "tokens") -> DataFrame:
    """Long rows ``keys, term_id, tf`` for the numbered ``terms``; other tokens are dropped."""
    counts = docs.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    return join_terms(counts, terms.select("term", "term_id"), "term", list(keys)).select(*keys, "term_id", "tf")
