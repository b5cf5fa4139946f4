"""A word-pair language model per class; a text belongs to the class that makes it most likely.

Scores follow stupid backoff (Brants et al. 2007): the share of a pair among the uses of its first
word, or ``BACKOFF`` times the share of the second word alone where the class lacks the pair. Word
shares are smoothed by one, so that unknown words score in every class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.tokens import words
from docspark.operators.labels import fit_labels, label_array
from docspark.operators.lookup import Lists, meet_terms, places
from docspark.session import materialize

BACKOFF = 0.4
BACKOFF_LOG = math.log(BACKOFF)
#: Part of a chunk's tokens that is scored together: nearly every pair is a term of its own, with its counts.
SHARE = 8


class NgramModel:
    """Fitted labels, the counts per class of every gram, and the words of each class with one for each distinct word."""

    def __init__(self, counts: DataFrame, sizes: list[float], labels: list[str]):
        self.counts = counts
        self.sizes = sizes
        self.labels = labels

    def predict(self, df: DataFrame, keys: list[str], text: str, output: str = "prediction") -> DataFrame:
        """``keys, prediction``, a row per text; null where there is no word.

        The grams of a text meet their counts by chunks of texts, where the weights are made: a pair's words
        are in its chunk, so no pair has to meet them elsewhere.
        """
        width, sizes = len(self.labels), np.array(self.sizes)

        def best(lists: Lists, found: pa.Table) -> pa.Array:
            n, owner, words = len(lists.lengths), lists.owners(), lists.tokens
            alone = places(words, found["term"])
            second, two = pairs_in(lists)
            pair = places(two, found["term"])
            known, paired = (at.is_valid().to_numpy(zero_copy_only=False) for at in (alone, pair))
            alone, pair = (pa.compute.fill_null(at, 0).to_numpy() for at in (alone, pair))
            second, pair = second[paired], pair[paired]
            scores = np.zeros((n, width))
            for i in range(width):
                counts = np.append(found[f"n_{i}"].to_numpy(), 0)
                single = np.log((np.where(known, counts[alone], 0) + 1) / sizes[i])
                has = counts[pair] > 0
                at = second[has]
                # What a pair adds to the backed-off score of its second word, whose factor all classes share.
                gain = np.log(counts[pair[has]] / counts[alone[at - 1]]) - BACKOFF_LOG - single[at]
                scores[:, i] = np.bincount(owner, weights=single, minlength=n) + np.bincount(owner[at], weights=gain, minlength=n)
            return pa.array(scores.round(8).argmax(axis=1).astype("int32"), mask=lists.lengths == 0)

        rows = df.select(*keys, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_words"))
        table = self.counts.withColumnRenamed("gram", "term")
        ranked = meet_terms(rows, "_words", table, best, "_rank", "int", grams_in, SHARE)
        return ranked.select(*keys, F.get(label_array(self.labels), F.col("_rank")).alias(output))

    def save(self, path: str) -> None:
        """Write the counts, and the labels with their sizes, below ``path``."""
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        rows = [(i, label, self.sizes[i]) for i, label in enumerate(self.labels)]
        saved = SparkSession.getActiveSession().createDataFrame(rows, "id int, label string, size double")
        saved.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> NgramModel:
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{path}/labels").orderBy("id").collect()
        return cls(spark.read.parquet(f"{path}/counts"), [row["size"] for row in rows], [row.label for row in rows])


def grams_of(words: Column) -> Column:
    """The words, then the pairs of words that follow each other, with a space between them."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def pairs_in(lists: Lists) -> tuple[np.ndarray, pa.Array]:
    """Where the second words of all pairs stand, and the pairs."""
    owner, words = lists.owners(), lists.tokens
    second = np.flatnonzero(np.append(False, owner[1:] == owner[:-1])[: len(owner)])
    return second, pa.compute.binary_join_element_wise(words.take(pa.array(second - 1)), words.take(pa.array(second)), " ")


def grams_in(lists: Lists) -> pa.Array:
    """``grams_of`` all lists, each gram once."""
    return pa.concat_arrays([lists.tokens.unique(), pairs_in(lists)[1].unique()])


def fit_ngrams(df: DataFrame, text: str, category: str, max_grams: int | None = None) -> NgramModel:
    """Fit on labelled texts. The model keeps all words and pairs, or the ``max_grams`` most frequent together.

    At equal counts words come before pairs, so the words of a kept pair are kept as well. The
    model is the table of counts; only totals reach the driver.
    """
    labels = fit_labels(df, category)
    ranks = range(len(labels))
    found = df.filter(F.col(category).isin(labels)).select(F.col(category).alias("_class"), words(F.col(text)).alias("_words"))
    found = found.select("_class", F.explode(grams_of(F.col("_words"))).alias("gram"))
    counts = found.groupBy("gram").agg(
        *[F.count(F.when(F.col("_class") == label, True)).alias(f"n_{i}") for i, label in enumerate(labels)]
    )
    total = sum((F.col(f"n_{i}") for i in ranks[1:]), F.col("n_0"))
    pair = F.col("gram").contains(" ")
    kept = counts if max_grams is None else counts.orderBy(total.desc(), pair, "gram").limit(max_grams)
    kept = materialize(kept, "gram-counts")
    totals = kept.filter(~pair).agg(F.count("*"), *[F.sum(f"n_{i}") for i in ranks]).first()
    if not totals[0]:
        raise ValueError("no words to fit on")
    return NgramModel(kept, [float(totals[1 + i] + totals[0]) for i in ranks], labels)
