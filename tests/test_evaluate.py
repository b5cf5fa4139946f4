import math
import random
from collections import Counter
from statistics import mode

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from docspark.functions.scores import argmax, cross_entropy, decode_label, head_forward, one_hot, target_index
from docspark.operators.evaluate import (
    accuracy,
    classification_report,
    confusion_matrix,
    confusion_wide,
    epoch_loss,
    majority_vote,
    mean_loss,
    pair_counts,
    report_labels,
    unseen_predictions,
)
from docspark.operators.labels import class_counts, encode_label, fit_labels, label_array, label_index, repair_category

# Class d is never predicted, class e never true, one truth is unknown.
ROWS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "e")] + [("d", "a")] * 2 + [("a", None)]


@pytest.fixture()
def pairs(spark):
    return pair_counts(spark.createDataFrame(ROWS, "label string, prediction string"))


def matrix(df):
    return {(row.label, row.prediction): row.n for row in df.collect()}


def test_confusion_matrix_label_sets(pairs):
    counts = Counter(ROWS)
    for labels, names in (("truth", "abd"), ("union", "abde"), (list("abz"), "abz")):
        expected = {(x, y): counts.get((x, y), 0) for x in names for y in names}
        assert matrix(confusion_matrix(pairs, labels)) == expected


def test_confusion_wide(pairs):
    wide = {row.label: tuple(row)[1:] for row in confusion_wide(pairs, list("abde")).collect()}
    assert wide == {"a": (5, 2, 0, 0), "b": (0, 3, 0, 1), "d": (2, 0, 0, 0), "e": (0, 0, 0, 0)}


def restated(rows, names, unknown="wrong"):
    result = {}
    for name in names:
        hits = sum(x == y == name for x, y in rows)
        predicted, support = sum(y == name for _, y in rows), sum(x == name for x, _ in rows)
        p, r = hits / predicted if predicted else 0.0, hits / support if support else 0.0
        result[name] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, support)
    total = sum(row[3] for row in result.values())
    lost = sum(x is None for x, _ in rows) if unknown == "wrong" else 0
    correct = sum(x == y and x in names for x, y in rows) / (total + lost)
    summary = {"accuracy": (correct,) * 3 + (total + lost,)}
    metrics = list(result.values())
    summary["macro avg"] = tuple(sum(m[i] for m in metrics) / len(metrics) for i in range(3)) + (total,)
    summary["weighted avg"] = tuple(sum(m[i] * m[3] for m in metrics) / total for i in range(3)) + (total,)
    return {**result, **summary}


@pytest.mark.parametrize("unknown", ["wrong", "skip"])
@pytest.mark.parametrize("labels, names", [("union", "abde"), ("truth", "abd"), (list("abdez"), "abdez")])
def test_classification_report(pairs, labels, names, unknown):
    got = {row["class"]: tuple(row)[1:] for row in classification_report(pairs, labels, unknown).collect()}
    expected = restated(ROWS, names, unknown)
    assert got.keys() == expected.keys()
    for name, values in expected.items():
        assert got[name] == pytest.approx(values), name


def test_label_sets(pairs):
    assert sorted(row.label for row in report_labels(pairs).collect()) == list("abde")
    assert [tuple(row) for row in unseen_predictions(pairs).collect()] == [("e", 1)]
    row = accuracy(pairs).first()
    assert (row.n, row.n_correct) == (len(ROWS), 8) and row.accuracy == pytest.approx(8 / len(ROWS))
    row = accuracy(pairs, "skip").first()
    assert row.n == sum(x is not None for x, _ in ROWS) and row.n_correct == 8


def test_thousands_of_classes(spark):
    n = 5000
    rows = spark.range(2 * n).selectExpr(f"concat('c', id % {n}) AS label", f"concat('c', (id * 7) % {n}) AS prediction")
    counted = pair_counts(rows)
    index = label_index(rows, "label").orderBy("label_id").collect()
    assert [r.label for r in index] == sorted(f"c{i}" for i in range(n)) and [r.label_id for r in index] == list(range(n))
    report = {r["class"]: r for r in classification_report(counted).collect()}
    assert len(report) == n + 3 and report["c0"].recall == 1.0 and report["c1"].recall == 0.0
    cells = confusion_matrix(counted.where("label < 'c11'")).agg(F.count("*"), F.sum("n")).first()
    names = {f"c{i}" for i in range(n) if f"c{i}" < "c11"}
    assert cells[0] == len(names) ** 2 and cells[1] == sum(f"c{i * 7 % n}" in names for i in range(2 * n) if f"c{i % n}" in names)


def test_vote_equals_mode_of_the_sequence(spark):
    rng = random.Random(1)
    rows = [(key, pos, rng.choice("abc")) for key in range(200) for pos in range(rng.randint(1, 7))]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "key int, pos int, label string").repartition(5)
    votes = {row.key: row.prediction for row in majority_vote(df, "key", "label", "pos").collect()}
    assert votes == {key: mode([label for k, _, label in rows if k == key]) for key in range(200)}


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("medicaldevices",)], "c string")
    assert fit_labels(df, "c") == ["a", "b", "medicaldevices"]
    assert [tuple(row) for row in label_index(df, "c").orderBy("label_id").collect()] == [(0, "a"), (1, "b"), (2, "medicaldevices")]
    with pytest.raises(ValueError):
        fit_labels(df, "c", max_classes=2)
    rows = df.select("c", encode_label(F.col("c"), ["a", "b"]).alias("i"), one_hot(F.col("c"), label_array(["a", "b"])).alias("o"))
    assert {(row.c, row.i, tuple(row.o)) for row in rows.collect()} == {
        ("a", 0, (1.0, 0.0)), ("b", 1, (0.0, 1.0)), (None, None, (0.0, 0.0)), ("medicaldevices", None, (0.0, 0.0)),
    }
    assert {row[0] for row in df.select(repair_category(F.col("c"))).collect()} == {"a", "b", None, "medicaldevice"}
    assert {row.c: row.n_docs for row in class_counts(df, "c").collect()} == {"a": 1, "b": 2, None: 1, "medicaldevices": 1}


def test_scores(spark):
    rows = [(1, [0.1, 0.9, 0.9], 1), (2, [1000.0, 0.0, -1000.0], 2), (3, [], 0)]
    df = spark.createDataFrame(rows, "i int, s array<double>, t int")
    got = df.select("i", argmax(F.col("s")).alias("a"), cross_entropy(F.col("s"), F.col("t")).alias("l")).orderBy("i").collect()
    assert [row.a for row in got] == [1, 0, None]
    assert got[0].l == pytest.approx(math.log(sum(math.exp(v) for v in rows[0][1])) - 0.9)
    assert got[1].l == pytest.approx(2000.0)
    names = df.select(decode_label(F.col("t"), label_array(["x", "y"])).alias("n")).collect()
    assert [row.n for row in names] == ["y", None, "x"]


def test_loss_target_of_an_unknown_category(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 0.0])], "i int, o array<double>")
    rows = df.select(target_index(F.col("o")).alias("a"), target_index(F.col("o"), "skip").alias("b")).collect()
    assert [tuple(row) for row in rows] == [(1, 1), (0, None)]


def test_head_forward_equals_numpy(spark):
    rng = np.random.default_rng(0)
    vectors, hidden, output = rng.normal(size=(50, 8)), rng.normal(size=(5, 8)), rng.normal(size=(3, 5))
    first, second = rng.normal(size=5), rng.normal(size=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "i int, v array<double>")
    rows = df.select("i", head_forward(hidden, output, first, second)("v").alias("s")).orderBy("i").collect()
    expected = np.maximum(vectors @ hidden.T + first, 0) @ output.T + second
    assert np.allclose([row.s for row in rows], expected)


def test_mean_of_means_differs_with_a_short_batch(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 6.0), (1, None)], "batch_id int, loss double")
    assert tuple(epoch_loss(df).first()) == (2, 3.75)
    assert tuple(mean_loss(df).first()) == (3, 3.0)


def test_weighted_rows_equal_mllibs(spark):
    rng = random.Random(8)
    rows = [(float(rng.randrange(4)), float(rng.randrange(5))) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    report = {row["class"]: row for row in classification_report(pair_counts(df)).collect()}
    for metric, row, column in (
        ("accuracy", "accuracy", "f1"),
        ("weightedPrecision", "weighted avg", "precision"),
        ("weightedRecall", "weighted avg", "recall"),
        ("f1", "weighted avg", "f1"),
    ):
        value = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert report[row][column] == pytest.approx(value)
