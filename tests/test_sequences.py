import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions.sequences import pad_sequence
from docspark.models.head import sequence_scorer
from docspark.plans.sequence import (
    evaluate_scores,
    score_sequences,
    sentence_rows,
    sequence_rows,
    vote_by_sentence,
    word_vocabulary,
)


def test_frame_truncate_pad(spark):
    n = 6
    rows = [(i, list(range(10, 10 + size))) for i, size in enumerate((0, 1, n - 2, n - 1, 3 * n))] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    for row in df.select("ids", pad_sequence(F.col("ids"), n).alias("s")).collect():
        framed = [0, *(row.ids or [])[: n - 2], 2]
        assert row.s.ids == framed + [1] * (n - len(framed))
        assert row.s.mask == [1] * len(framed) + [0] * (n - len(framed))
        assert row.s.token_type_ids == [0] * n
    with pytest.raises(ValueError):
        pad_sequence(F.col("ids"), 1)


def test_words_to_sequences(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, "a zz"), (3, None), (4, "")], "doc_id long, text string")
    vocabulary = word_vocabulary(docs.filter("doc_id = 1"), "text")
    assert {row.term: row.value for row in vocabulary.collect()} == {"a": 4, "b": 5}
    rows = {row.doc_id: row.ids for row in sequence_rows(docs, "text", ["doc_id"], vocabulary, 5).collect()}
    assert rows == {1: [0, 5, 4, 4, 2], 2: [0, 4, 3, 2, 1], 3: [0, 2, 1, 1, 1], 4: [0, 2, 1, 1, 1]}


def test_sentence_vote_ties_and_empty_documents(spark):
    docs = spark.createDataFrame(
        [(1, "x one. y two. y three. x four."), (2, "y a."), (3, ""), (4, None), (5, "q. y b.")], "doc_id long, text string"
    )

    def score(rows):
        first = F.substring("sentence", 1, 1)
        return rows.withColumn("label", F.when(first.isin("x", "y"), first))

    votes = {row.doc_id: row.prediction for row in vote_by_sentence(docs, "doc_id", "text", score).collect()}
    assert votes == {1: "x", 2: "y", 3: None, 4: None, 5: "y"}
    assert sentence_rows(docs, "doc_id", "text").count() == 9
    always = vote_by_sentence(docs, "doc_id", "text", lambda rows: rows.withColumn("label", F.lit("z")))
    assert {row.doc_id: row.prediction for row in always.collect()} == {1: "z", 2: "z", 3: None, 4: None, 5: "z"}


def test_scoring_of_sequences(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    sequences = sequence_rows(docs, "text", ["doc_id"], word_vocabulary(docs, "text"), 4)

    def load():
        return lambda ids, mask, kinds: np.stack([(ids * mask).sum(axis=1), mask.sum(axis=1)], axis=1).astype("float64")

    scored = score_sequences(sequences, sequence_scorer(load, 4))
    assert {row.doc_id: row.scores for row in scored.collect()} == {1: [11.0, 4.0], 2: [6.0, 3.0]}


def test_validation_of_scores(spark):
    rows = [("a", [2.0, 0.0]), ("b", [1.0, 0.0]), ("b", [0.0, 3.0]), ("new", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "category string, scores array<double>")

    def loss(scores, target):
        return np.log(np.exp(scores).sum()) - scores[target]

    known = [loss(np.array(s), "ab".index(c)) for c, s in rows[:3]]
    for unknown, expected in (("class0", known + [loss(np.array(rows[3][1]), 0)]), ("skip", known)):
        mean, report, matrix = evaluate_scores(df, "category", ["a", "b"], unknown=unknown)
        row = mean.first()
        assert row.n_docs == len(expected) and row.loss == pytest.approx(np.mean(expected))
    assert {tuple(row) for row in matrix.collect()} == {("a", "a", 1), ("a", "b", 0), ("b", "a", 1), ("b", "b", 1)}
    assert {row["class"]: row.support for row in report.collect()} == {
        "a": 1, "b": 2, "accuracy": 3, "macro avg": 3, "weighted avg": 3,
    }
