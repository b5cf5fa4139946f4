"""Top-1 language of a text: multinomial naive Bayes over terms, fitted on labelled texts.

Stands in for a native detector with built-in tables, so its answers are not numerically those of
that detector. The profile is a table of all terms of the labelled texts with a weight per language;
the languages weigh the same. Texts that share no term with it have no language. Terms are words
or, for scripts without spaces, runs of ``gram`` characters (Cavnar and Trenkle 1994).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.tokens import NON_WORD, grams
from docspark.operators.labels import fit_labels, label_array
from docspark.operators.lookup import Lists, meet_terms, places
from docspark.session import materialize


class LanguageModel:
    """Fitted labels and the table ``term, weights`` with a log probability per label."""

    def __init__(self, profile: DataFrame, labels: list[str], gram: int | None = None):
        self.profile = profile
        self.labels = labels
        self.gram = gram

    def transform(self, df: DataFrame, text: str, output: str = "prediction", keys: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
        """Add the top-ranked language, null where no term is known; ties go to the first label.

        Every row is a text of its own, whatever its ``keys``. Terms meet the profile by chunks of texts, which
        move with the columns to ``keep``, by default all.
        """
        keep = df.columns if keep is None else keep
        width = len(self.labels)

        def best(lists: Lists, found: pa.Table) -> pa.Array:
            place = places(lists.tokens, found["term"])
            known = place.is_valid().to_numpy(zero_copy_only=False)
            at, owner, n = place.drop_null().to_numpy(), lists.owners()[known], len(lists.lengths)
            weights = found["weights"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            sums = np.stack([np.bincount(owner, weights=weights[at, i], minlength=n) for i in range(width)], axis=1)
            return pa.array(sums.round(8).argmax(axis=1).astype("int32"), mask=np.bincount(owner, minlength=n) == 0)

        terms = df.select(*keep, _terms(F.col(text), self.gram).alias("_terms"))
        ranked = meet_terms(terms, "_terms", self.profile, best, "_rank", "int")
        return ranked.select(*keep, F.get(label_array(self.labels), F.col("_rank")).alias(output))

    def save(self, path: str) -> None:
        """Write the profile and the label list below ``path``."""
        self.profile.write.mode("overwrite").parquet(f"{path}/profile")
        rows = [(i, label, self.gram) for i, label in enumerate(self.labels)]
        saved = SparkSession.getActiveSession().createDataFrame(rows, "id int, label string, gram int")
        saved.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> LanguageModel:
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{path}/labels").orderBy("id").collect()
        return cls(spark.read.parquet(f"{path}/profile"), [row.label for row in rows], rows[0].gram)


def _terms(text: Column, gram: int | None) -> Column:
    """Terms of a text, with the empty pieces that a split may have."""
    found = F.split(F.lower(text), NON_WORD) if gram is None else grams(text, gram)
    return F.coalesce(found, F.array().cast("array<string>"))


def profile_counts(
    df: DataFrame, text: str, language: str, labels: list[str], max_terms: int | None = None, gram: int | None = None
) -> DataFrame:
    """``term, counts``: occurrences per language of every term, or of the ``max_terms`` most frequent.

    One aggregate with a counter per language; a term shared by all texts is counted down to one
    row per task before the shuffle. Equal totals are ordered by the term.
    """
    found = df.filter(F.col(language).isin(labels)).select(
        F.col(language).alias("_lang"), F.explode(_terms(F.col(text), gram)).alias("term")
    )
    each = [F.count(F.when(F.col("_lang") == label, True)) for label in labels]
    counts = found.filter(F.col("term") != "").groupBy("term").agg(F.array(*each).alias("counts"))
    if max_terms is None:
        return counts
    return counts.orderBy(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n).desc(), "term").limit(max_terms)


def _weighed(counts: DataFrame, labels: list[str], smoothing: float) -> DataFrame:
    """Add ``weights``, the smoothed log shares; only the totals per language reach the driver."""
    ranks = range(len(labels))
    totals = counts.agg(F.count("*"), *[F.sum(F.col("counts")[i]) for i in ranks]).first()
    if not totals[0]:
        raise ValueError("no terms to fit on")
    sizes = [float(totals[1 + i] + smoothing * totals[0]) for i in ranks]
    return counts.withColumn("weights", F.array(*[F.log((F.col("counts")[i] + smoothing) / sizes[i]) for i in ranks]))


def fit_language_model(
    df: DataFrame,
    text: str,
    language: str,
    smoothing: float = 1.0,
    max_terms: int | None = None,
    gram: int | None = None,
) -> LanguageModel:
    """Fit on labelled texts, in one pass over them; the profile is written once."""
    labels = fit_labels(df, language)
    counts = materialize(profile_counts(df, text, language, labels, max_terms, gram), "profile")
    return LanguageModel(_weighed(counts, labels, smoothing).select("term", "weights"), labels, gram)


def language_profile(
    df: DataFrame, text: str, language: str, smoothing: float = 1.0, max_terms: int | None = None
) -> DataFrame:
    """``lang, term, n, log_prob``: the profile as a table, for the terms each language has."""
    labels = fit_labels(df, language)
    counts = materialize(profile_counts(df, text, language, labels, max_terms), "profile")
    entries = [
        F.struct(F.lit(label).alias("lang"), "term", F.col("counts")[i].alias("n"), F.col("weights")[i].alias("log_prob"))
        for i, label in enumerate(labels)
    ]
    return _weighed(counts, labels, smoothing).select(F.inline(F.array(*entries))).filter(F.col("n") > 0)
