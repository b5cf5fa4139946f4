import math
import re
import tracemalloc

import numpy as np
import pytest
from odd_rows import ODD

from docspark.llm import toxicity
from docspark.llm.toxicity import INNER_WEIGHT, REFIT, Entries, SeverityModel, fit_from_labels, fit_severity, graded_labels, label_sample, with_severity

FOLDER = "/root/testdata/sf0.1"


def made(n=600):
    rng = np.random.default_rng(7)
    texts, grades = [], []
    for i in range(n):
        grade = int(rng.integers(0, 4))
        own = [f"n{chr(97 + k % 14)}{chr(97 + k // 14)}" for k in rng.integers(0, 196, 30)] + ["bad" + "abcdefghi"[k] * 2 for k in rng.integers(0, 9, 2 * grade)]
        texts.append(" ".join(rng.permutation(own)).upper() + "!")
        grades.append(grade)
    return texts, np.array(grades)


def test_grades_are_ordered_and_held_out_texts_are_graded():
    texts, grades = made()
    model = fit_severity(texts[:400], grades[:400], max_share=1.0)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    above = model.above(texts[400:])
    assert (np.diff(above, axis=1) <= 0).all()
    severity = above.sum(axis=1)
    assert np.corrcoef(severity, grades[400:])[0, 1] > 0.85
    means = [severity[grades[400:] == k].mean() for k in range(4)]
    assert means == sorted(means)


def test_weights_are_a_maximum_without_the_penalty():
    texts, grades = made(300)
    grades = np.minimum(grades, 1)
    model = fit_severity(texts, grades, max_share=1.0)
    above = model.above(texts)
    assert ((above[:, 0] > 0.5) == (grades == 1)).mean() > 0.95


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    graded = graded_labels(labels)
    part = "pmod(xxhash64(doc_id), 3) = 0"
    model = fit_from_labels(docs, graded.where(f"NOT {part}"))
    scored = with_severity(docs, model).join(labels.where(part).where("toxic IS NOT NULL").selectExpr("doc_id", "toxic"), "doc_id").select("toxic", "toxicity.top").collect()
    hit = sum(r.toxic == 1 and r.top >= 0.5 for r in scored) / sum(r.toxic == 1 for r in scored)
    false = sum(r.toxic == 0 and r.top >= 0.5 for r in scored) / sum(r.toxic == 0 for r in scored)
    assert hit > 0.7 and false < 0.01


def test_odd_rows_and_labels(spark, odd, documents):
    labels = spark.createDataFrame([(1, 2), (1, 0), (2, 0), (None, 1), (4, None), (77, 1), (6, 0)], "doc_id long, grade int")
    assert sorted(map(tuple, label_sample(labels, 10).collect())) == [(1, 2), (2, 0), (6, 0), (77, 1)]
    model = fit_from_labels(odd, labels, min_docs=1)
    scored = with_severity(odd, model)
    assert scored.columns == [*odd.columns, "toxicity"] and scored.count() == len(ODD)
    assert with_severity(documents([]), model).count() == 0
    none = fit_from_labels(documents([]), labels)
    assert none == SeverityModel()
    assert {tuple(r.toxicity) for r in with_severity(odd, none).collect()} == {(0.0, 0.0)}


def test_sample_is_bounded(spark):
    labels = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS grade")
    assert label_sample(labels, 20).groupBy("grade").count().collect() and label_sample(labels, 20).count() == 60


@pytest.mark.parametrize("toxic,quality,grade", [(1, 1, 2), (0, 0, 1), (0, 1, 0), (0, None, 0), (None, 0, None)])
def test_grades_of_labels(spark, toxic, quality, grade):
    row = spark.createDataFrame([(1, quality, toxic)], "doc_id long, quality int, toxic int")
    assert graded_labels(row).first().grade == grade


def plain_features(text):
    words = set()
    for word in re.split(r"[\W\d_]+", (text or "").lower()):
        words.add(word)
        words |= {word[:k] + "*" for k in (4, 5, 6) if len(word) > k}
    return words - {""}


def plain_chances(model, text):
    """P(grade = 0), P(grade = 1), ... one text and one threshold at a time."""
    score = sum(model.weights.get(f, 0.0) for f in plain_features(text))
    below = [0.0, *(1 / (1 + math.exp(score - t)) for t in model.thresholds), 1.0]
    return [b - a for a, b in zip(below, below[1:])]


def test_severity_equals_the_plain_model(spark, documents):
    texts, grades = made(200)
    model = fit_severity(texts, grades, max_share=1.0)
    rows = [(i, t, "s") for i, t in enumerate(texts[:50] + ["", None, "   ", "badaa badaa", "BADAAX 12 badbb_badcc", "ÀÉ日本 badaaé"])]
    for r in with_severity(documents(rows), model).collect():
        chances = plain_chances(model, rows[r.doc_id][1])
        assert r.toxicity.severity == pytest.approx(sum(k * p for k, p in enumerate(chances)), abs=1e-9)
        assert r.toxicity.top == pytest.approx(chances[-1], abs=1e-9)


def test_the_fit_is_a_maximum_of_the_plain_likelihood():
    texts, grades = made(150)
    penalty = 5e-2
    model = fit_severity(texts, grades, max_share=1.0, penalty=penalty, steps=3000)

    def value(weights, thresholds):
        tried = SeverityModel(weights, thresholds)
        logs = [math.log(plain_chances(tried, t)[g]) * (1.0 if g in (0, 3) else INNER_WEIGHT) for t, g in zip(texts, grades)]
        return sum(logs) / len(texts) - REFIT * penalty * sum(map(abs, weights.values()))

    best = value(model.weights, model.thresholds)
    for name in sorted(model.weights)[::7]:
        for step in (-1e-2, 1e-2):
            assert value({**model.weights, name: model.weights[name] + step}, model.thresholds) < best + 1e-6
    for k in range(3):
        for step in (-1e-2, 1e-2):
            assert value(model.weights, tuple(t + step * (i == k) for i, t in enumerate(model.thresholds))) < best + 1e-6


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_sums_by_blocks_are_those_of_all_entries(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(3)
    lengths = np.array([0, 0, 5, 20, 0, 1, 3, 0])
    column = rng.integers(0, 9, lengths.sum()).astype("int32")
    row, kept = np.repeat(np.arange(8), lengths), np.array([1, 0, 1, 1, 0, 1, 1, 1, 0], bool)
    for entries, r, c, n in ((Entries(column, lengths), row, column, 9), (Entries(column, lengths).only(kept), row[kept[column]], (np.cumsum(kept) - 1)[column[kept[column]]], 6)):
        values, of_texts = rng.normal(size=n), rng.normal(size=8)
        assert entries.column.dtype == "int32" and entries.column.tolist() == c.tolist()
        assert entries.row_sums(values).tolist() == np.bincount(r, weights=values[c], minlength=8).tolist()
        assert entries.column_sums(of_texts, n).tolist() == np.bincount(c, weights=of_texts[r], minlength=n).tolist()


def test_a_fit_holds_few_bytes_an_entry():
    words = [a + b for a in "abcdefghijklmnopqrstuvwxy" for b in "abcdefghijklmnopqrst"]
    texts, grades = [" ".join(words)] * 4000, np.arange(4000) % 3
    tracemalloc.start()
    fit_severity(texts, grades, max_share=1.0, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(words) * len(texts)
