import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from docspark.models.bags import packed
from docspark.models.features import dense_topics, drop_small, gamma_scale
from docspark.models.head import fit_head
from docspark.models.svm import KernelMachine, fit_kernel_svm, fit_machines, hinge_sums, sign_matrix
from docspark.models.vectors import fit_vectors
from docspark.operators.vocabulary import document_frequency, number_terms
from docspark.plans.classical import DomainModel, document_tokens, evaluate_domains, fit_domain_model, predict_domains

TOPICS = {
    "banking": "bank loan interest account credit money payment".split(),
    "legal": "court law judge contract claim lawyer trial".split(),
    "tourism": "beach hotel travel flight island tour guide".split(),
}


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(sorted(TOPICS))
        rows.append((i, " ".join(rng.choices(TOPICS[name], k=20) + rng.choices(sum(TOPICS.values(), []), k=5)), name))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(1, 240), "doc_id long, text string, category string").cache()


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 3, 1500)
    radius, angle = label + 1 + rng.normal(scale=0.1, size=1500), rng.uniform(0, 2 * np.pi, 1500)
    points = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    rows = [(float(y), p.tolist(), i < 1200) for i, (y, p) in enumerate(zip(label, points))]
    df = spark.createDataFrame(rows, "label double, p array<double>, fit boolean")
    return df.select("label", array_to_vector("p").alias("features"), "fit").cache()


def share_right(df, column="class"):
    return df.select(F.avg((F.col("label") == F.col(column)).cast("double"))).first()[0]


@pytest.mark.parametrize("scheme", ["rest", "pairs"])
def test_kernel_machine_separates_rings(rings, scheme, tmp_path):
    fit, held = rings.filter("fit"), rings.filter("NOT fit")
    machine = fit_kernel_svm(fit.drop("fit"), scheme=scheme)
    scored = machine.transform(held)
    assert share_right(scored) > 0.95
    linear = OneVsRest(classifier=LinearSVC(maxIter=20)).fit(fit).transform(held)
    assert share_right(linear, "prediction") < 0.7
    machine.write().save(str(tmp_path / "machine"))
    again = KernelMachine.load(str(tmp_path / "machine")).transform(held)
    assert again.select("class").collect() == scored.select("class").collect()


def test_gamma_is_one_over_width_times_variance(rings):
    values = np.array([row.features.toArray() for row in rings.collect()])
    assert gamma_scale(rings, "features") == pytest.approx(1 / (2 * values.var()))


def test_domain_model_end_to_end(spark, docs, tmp_path):
    limits = {"min_docs": 3, "max_share": 0.9}
    model = fit_domain_model(docs, "text", "category", topics=3, vector_size=8, limits=limits, size=64)
    held = spark.createDataFrame(made(2, 90), "doc_id long, text string, category string")
    predicted = predict_domains(held, model, "text")
    rows = predicted.orderBy("doc_id").collect()
    assert len(rows) == 90 and sum(row.category == row.prediction for row in rows) > 80
    model.save(str(tmp_path / "model"))
    again = predict_domains(held, DomainModel.load(str(tmp_path / "model")), "text")
    assert again.orderBy("doc_id").collect() == rows
    report, matrix = evaluate_domains(predicted, "category", model)
    assert report.count() == 6 and matrix.agg(F.sum("n")).first()[0] == 90


def test_tokens_with_own_stop_words_and_lemmas(spark):
    df = spark.createDataFrame([(1, "The banks lend 20"), (2, None)], "doc_id long, text string")
    lemmas = spark.createDataFrame([("banks", "bank")], "term string, value string")
    rows = document_tokens(df, "text", ["lend"], lemmas, ["doc_id"]).orderBy("doc_id").collect()
    assert [row.tokens for row in rows] == [["the", "bank", "NUM"], []]


def tokens_of(docs):
    return docs.select("doc_id", "category", F.split("text", " ").alias("tokens"))


@pytest.mark.parametrize("scheme", ["rest", "pairs"])
def test_all_machines_are_one_matrix(spark, scheme):
    """Loss and gradient of every machine against each one's own plain sums, and its minimum."""
    rng = np.random.default_rng(3)
    label, x = rng.integers(0, 3, 90), rng.normal(size=(90, 4))
    x[:, 0] += 2 * label
    projection, offsets = rng.normal(size=(16, 4)), rng.uniform(0, 6, 16)
    mapped = np.hstack([np.sqrt(2 / 16) * np.cos(x @ projection.T + offsets), np.ones((90, 1))])
    signs = sign_matrix(3, scheme)
    rows = spark.createDataFrame([(float(y), v.tolist()) for y, v in zip(label, x)], "label double, features array<double>").repartition(3)

    def plain(points):
        out = []
        for m, w in enumerate(points):
            y = signs[label, m]
            short = np.where(y != 0, np.maximum(0, 1 - y * (mapped @ w)), 0)
            out.append([0.5 * (short**2).sum(), *-(short * y) @ mapped])
        return np.array(out)

    points = rng.normal(size=(signs.shape[1], 17))
    assert np.allclose(hinge_sums(rows, points, projection, offsets, signs), plain(points))
    evaluate = lambda p: (plain(p)[:, 0] + 0.5 * (p**2).sum(axis=1), plain(p)[:, 1:] + p)
    best = fit_machines(evaluate, signs.shape[1], 17, 200, 1e-9)
    assert np.abs(evaluate(best)[1]).max() < 1e-6


def test_a_fit_reads_the_rows_once_a_step(rings, monkeypatch):
    from docspark.models import svm

    scans = []
    whole = svm.hinge_sums
    monkeypatch.setattr(svm, "hinge_sums", lambda *a: scans.append(1) or whole(*a))
    svm.fit_kernel_svm(rings.drop("fit"), scheme="pairs", size=32, max_iter=5)
    assert len(scans) <= 6


def test_small_topic_scores_are_dropped(spark):
    df = spark.createDataFrame([([0.005, 0.01, 0.985],)], "a array<double>")
    assert df.select(drop_small(F.col("a"))).first()[0] == [0.0, 0.01, 0.985]


def test_dense_topics_cover_every_row(spark):
    rows = [(1, [(0, 0.5), (2, 0.5)]), (2, [(1, 0.995), (2, 0.005)]), (3, [])]
    df = spark.createDataFrame(rows, "i int, p array<struct<topic:int,score:double>>")
    got = {row.i: row.d for row in df.select("i", dense_topics(F.col("p"), 3).alias("d")).collect()}
    assert got == {1: [0.5, 0.0, 0.5], 2: [0.0, 0.995, 0.0], 3: [0.0, 0.0, 0.0]}


@pytest.mark.parametrize("kind", ["layers", "softmax"])
def test_heads_learn_from_document_vectors(docs, kind):
    tokens = tokens_of(docs).withColumn(
        "label", F.array_position(F.array(*map(F.lit, sorted(TOPICS))), F.col("category")).cast("double") - 1
    )
    terms = number_terms(document_frequency(tokens))
    bags = packed(tokens, terms, "doc_id")
    vectors = fit_vectors(bags, terms, "doc_id", 240, size=8).vectors(bags, "doc_id").join(tokens, "doc_id")
    vectors = vectors.withColumn("vector", array_to_vector("vector")).cache()
    scored = fit_head(vectors, 3, kind=kind).transform(vectors)
    assert scored.count() == 240 and share_right(scored) > 0.8
