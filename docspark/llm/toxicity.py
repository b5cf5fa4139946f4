"""Toxicity by cumulative-link ordinal regression over the words of a text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import whole_text
from docspark.session import materialize

#: Labelled rows per grade that a fit reads at most; the only bound of this module.
SAMPLE_PER_GRADE = 6_000
#: Sampled documents a word needs to become a feature, greatest share of them it may be in, penalty of a weight, steps.
MIN_DOCS, MAX_SHARE, PENALTY, STEPS = 5, 0.5, 2e-3, 200

#: Counters that pick the features a fit lists.
COUNTERS = 1 << 22
#: Lengths of the beginnings of words that are features too, so that unseen forms of a known stem count.
STEMS = (4, 5, 6)
#: Weight of the examples of the grades between the lowest and the highest.
INNER_WEIGHT = 0.25
#: Entries of texts' features that are summed at a time.
BLOCK = 1 << 16
#: Share of the penalty that stays when the weights that are not zero are fitted again.
REFIT = 0.02

WORDS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The distinct words of a whole text, in lower case, and their beginnings, marked by a star."""
    found = set(WORDS.findall(text.lower()))
    return found.union(*({w[:k] + "*" for w in found if len(w) > k} for k in STEMS))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class SeverityModel:
    """One weight per word, shared by all thresholds, and the ascending thresholds between grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def above(self, texts: list[str]) -> np.ndarray:
        """Per text the probabilities that its grade is at least 1, 2, and so on."""
        known = self.weights.keys()
        score = np.array([sum(self.weights[w] for w in sorted(features(t) & known)) for t in texts])
        return logistic(score[:, None] - np.array(self.thresholds)[None, :])


class Entries:
    """Which features each text has: the features' numbers, text by text, and how many a text has.

    Sums go over some texts at a time, so that no array but the numbers is as long as all entries.
    """

    def __init__(self, column: np.ndarray, lengths: np.ndarray):
        self.column, self.lengths = column, lengths
        self.ends = np.cumsum(lengths)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First text, end, and of each entry the text, counted from the first, and the feature."""
        first, done = 0, 0
        while first < len(self.lengths):
            end = max(first + 1, int(np.searchsorted(self.ends, done + BLOCK, "right")))
            yield first, end, np.repeat(np.arange(end - first), self.lengths[first:end]), self.column[done : self.ends[end - 1]]
            first, done = end, int(self.ends[end - 1])

    def only(self, kept: np.ndarray) -> Entries:
        """The entries of some features, which are numbered anew in their order."""
        number = (np.cumsum(kept) - 1).astype("int32")
        lengths, columns = np.zeros_like(self.lengths), [self.column[:0]]
        for first, end, row, column in self.blocks():
            use = kept[column]
            lengths[first:end] = np.bincount(row[use], minlength=end - first)
            columns.append(number[column[use]])
        return Entries(np.concatenate(columns), lengths)

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        """Per text the sum of its features' values."""
        return np.concatenate([np.bincount(row, weights=values[column], minlength=end - first) for first, end, row, column in self.blocks()])

    def column_sums(self, values: np.ndarray, n: int) -> np.ndarray:
        """Per feature the sum of its texts' values, in the order of the texts."""
        sums = np.zeros(n)
        for first, end, row, column in self.blocks():
            np.add.at(sums, column, values[first:end][row])
        return sums


def fit_severity(texts: list[str], grades: np.ndarray, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, penalty: float = PENALTY, steps: int = STEPS) -> SeverityModel:
    """Maximum likelihood of the cumulative logistic model, with an absolute penalty on the weights.

    ``P(grade <= k) = logistic(threshold_k - score)``: a text's score is the sum of the weights of
    its words. Accelerated proximal steps; the thresholds are a first one and positive gaps, so
    they stay in order. Grades without examples leave their thresholds at the starting point.
    """
    if not len(texts) or grades.max() <= 0:
        return SeverityModel()
    top = int(grades.max())
    # Most features are too rare. Counters by hash, never too low, tell nearly all of them without a list of all.
    counters = np.zeros(COUNTERS, "int32")
    for text in texts:
        counters[np.unique(np.fromiter((hash(w) % COUNTERS for w in features(text)), "int64"))] += 1
    index: dict[str, int] = {}
    columns, lengths = array("i"), []
    for text in texts:
        found = [index.setdefault(w, len(index)) for w in sorted(features(text)) if counters[hash(w) % COUNTERS] >= min_docs]
        columns.extend(found)
        lengths.append(len(found))
    del counters
    if not index:
        return SeverityModel()
    entries = Entries(np.frombuffer(columns, "int32"), np.array(lengths))
    docs = sum(np.bincount(c, minlength=len(index)) for _, _, _, c in entries.blocks())
    kept = (docs >= min_docs) & (docs <= max(min_docs, max_share * len(texts)))
    entries = entries.only(kept)
    del columns
    weight = np.where((grades == 0) | (grades == top), 1.0, INNER_WEIGHT)
    n_words, n = int(kept.sum()), len(texts)
    share = (np.array([(grades <= k).sum() for k in range(top)]) + 0.5) / (n + 1)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    first, gaps, w = start[0], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(n_words)
    for refit in (False, True):  # once more over the words found, almost without the penalty that shrinks them
        chosen = w != 0 if refit else np.ones(n_words, bool)
        if refit:
            entries, w = entries.only(chosen), w[chosen]
        ahead, momentum, rate, force = w, 1.0, 4.0 / max(1.0, len(entries.column) / n), penalty * (REFIT if refit else 1.0)
        for _ in range(steps):
            edges = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [np.inf]])
            score = entries.row_sums(ahead)
            high, low = logistic(edges[grades + 1] - score), logistic(edges[grades] - score)
            p = np.maximum(high - low, 1e-9)
            at = np.zeros(top + 2)
            np.add.at(at, grades + 1, weight * high * (1 - high) / p)
            np.add.at(at, grades, -weight * low * (1 - low) / p)
            at = at[1:-1] / n
            gradient = entries.column_sums(weight * (high + low - 1), len(w)) / n
            moved = ahead + rate * gradient
            new = np.sign(moved) * np.maximum(np.abs(moved) - rate * force, 0)
            faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            ahead, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
            first += 2.0 * at.sum()
            gaps = gaps + 2.0 * np.cumsum(at[::-1])[::-1][1:] * np.exp(gaps)
    names = np.array(list(index), object)[kept][chosen]
    edges = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return SeverityModel({names[i]: float(w[i]) for i in np.flatnonzero(w)}, tuple(map(float, edges)))


def label_sample(labels: DataFrame, per_grade: int = SAMPLE_PER_GRADE) -> DataFrame:
    """At most ``per_grade`` ids of each grade, those with the smallest hashes; the highest grade of an id counts."""
    graded = labels.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    top = graded.agg(F.max("grade")).first()[0]
    picked = [graded.where(F.col("grade") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade) for k in range((top or 0) + 1)]
    sample = picked[0]
    for more in picked[1:]:
        sample = sample.unionByName(more)
    return sample


def fit_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_grade: int = SAMPLE_PER_GRADE, **options) -> SeverityModel:
    """Fit on a bounded sample of labelled documents, in one task; only non-zero weights come back.

    The sample's ids have a proven bound and are broadcast, so the documents are only scanned.
    """
    sample = label_sample(labels, per_grade)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = materialize(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade"), "labelled")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = sorted(row for batch in batches for row in zip(*[batch.column(name).to_pylist() for name in ("doc_id", "text", "grade")]))
        model = fit_severity([t for _, t, _ in examples], np.array([g for _, _, g in examples], "int64"), **options)
        words, values = [None] * len(model.thresholds) + list(model.weights), [*model.thresholds, *model.weights.values()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(values, pa.float64())], ["word", "value"])

    found = rows.repartition(1).mapInArrow(fit, "word string, value double").collect()
    return SeverityModel({r["word"]: r["value"] for r in found if r["word"] is not None}, tuple(r["value"] for r in found if r["word"] is None))


def with_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """Add a struct ``name``: expected ``severity``, and ``top``, the probability of the highest grade.

    Every whole text is scored in the scan's tasks. A null text is empty and scores as no words. A
    model without grades gives 0 for both. Other columns pass through.
    """

    @F.pandas_udf("severity double, top double")
    def score(texts: pd.Series) -> pd.DataFrame:
        above = model.above(texts.tolist())
        return pd.DataFrame({"severity": above.sum(axis=1), "top": above[:, -1] if above.shape[1] else 0.0})

    return docs.withColumn(name, score(whole_text(text_col)))


def graded_labels(labels: DataFrame) -> DataFrame:
    """Grades of unwanted text from the table of labels: 0 good, 1 poor, 2 toxic; null where toxic is null."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 2).when(F.col("toxic") == 0, F.when(F.col("quality") == 0, 1).otherwise(0)).alias("grade"))
