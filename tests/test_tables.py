"""Topics and vectors held in tables, against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.models import bags as bag_tables
from docspark.models import topics
from docspark.models.bags import packed, term_places, write_weights
from docspark.models.topics import TopicModel, digamma, fit_topics, log_gamma
from docspark.models.vectors import VectorModel, fit_vectors, projected
from docspark.operators.vocabulary import bag_of_words, document_frequency, number_terms

GROUPS = {"bank": "bank loan interest account credit money".split(), "law": "court law judge contract claim trial".split(), "sea": "beach hotel flight island tour guide".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        name = rng.choice(sorted(GROUPS))
        rows.append((i, name, rng.choices(GROUPS[name], k=20) + rng.choices(sum(GROUPS.values(), []), k=3)))
    rows += [(150, "none", []), (151, "none", None), (152, "none", ["unheard"])]
    return spark.createDataFrame(rows, "doc long, name string, tokens array<string>").cache()


@pytest.fixture(scope="module")
def terms(docs):
    return number_terms(document_frequency(docs.where("doc < 150"))).cache()


@pytest.fixture(params=["one block", "many blocks"])
def bags(docs, terms, request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(bag_tables, "BLOCK", 5)
        monkeypatch.setattr(bag_tables, "ENTRIES", 40)
    return packed(docs, terms, "doc")


def matrix(docs, terms):
    counts = np.zeros((153, terms.count()))
    for row in bag_of_words(docs, terms, "doc").collect():
        counts[row.doc, row.term_id] = row.tf
    return counts


def test_gamma_functions():
    x = np.array([0.05, 0.11, 0.5, 1, 2.5, 7, 300, 1e6])
    step = 1e-5 * np.maximum(x, 0.1)
    assert np.allclose(digamma(x), (log_gamma(x + step) - log_gamma(x - step)) / (2 * step), rtol=1e-5)
    assert np.allclose(log_gamma(np.array([1.0, 5, 0.5])), [0, np.log(24), np.log(np.sqrt(np.pi))], atol=1e-10)


def plain_topics(counts, first, prior, eta, passes, steps):
    """The same updates over a dense matrix; the bound before each update of the weights."""
    weights, some = first.copy(), counts[counts.sum(axis=1) > 0]
    k = weights.shape[1]
    gamma = prior + some.sum(axis=1, keepdims=True) / k * np.ones(k)
    bounds = []
    for _ in range(passes):
        expected = digamma(weights) - digamma(weights.sum(axis=0))
        beta = np.exp(expected)
        for _ in range(steps):
            theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
            gamma = prior + theta * ((some / (theta @ beta.T)) @ beta)
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
        norm = theta @ beta.T
        e = digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))
        bound = (some * np.log(norm)).sum() + ((prior - gamma) * e + log_gamma(gamma) - log_gamma(np.array(prior))).sum()
        bound += (log_gamma(np.array(k * prior)) - log_gamma(gamma.sum(axis=1))).sum()
        bound += ((eta - weights) * expected + log_gamma(weights) - log_gamma(np.array(eta))).sum()
        bound += (log_gamma(np.array(len(weights) * eta)) - log_gamma(weights.sum(axis=0))).sum()
        bounds.append(bound)
        weights = eta + beta * ((some / norm).T @ theta)
    return weights, bounds


def test_topics_equal_dense_updates(docs, terms, spark):
    bags = packed(docs, terms, "doc")
    model = fit_topics(bags, terms, "doc", k=3, passes=4, watch=True)
    uniform = [(F.pmod(F.xxhash64("term", F.lit(j), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)) for j in range(3)]
    rows = terms.orderBy("term_id").select("df", *uniform).collect()
    first = np.array([[1 / 3 + r[0] * (0.5 + u) / 3 for u in r[1:]] for r in rows])
    weights, bounds = plain_topics(matrix(docs, terms), first, 1 / 3, 1 / 3, 4, topics.STEPS)
    assert np.allclose(model.bounds, bounds)
    got = {r.id: r.weights for r in bag_tables.read_weights(spark, model.path).collect()}
    assert np.allclose([got[i] for i in range(len(weights))], weights)


def test_the_bound_rises_and_topics_find_the_groups(docs, terms, bags, tmp_path):
    model = fit_topics(bags, terms, "doc", k=3, passes=5 if bag_tables.BLOCK == 5 else 7, watch=True)
    assert all(b > a for a, b in zip(model.bounds, model.bounds[1:]))
    rows = model.shares(bags, "doc").join(docs, "doc").collect()
    assert len(rows) == 150 and all(abs(sum(r.topics) - 1) < 1e-9 for r in rows)
    main = {}
    for r in rows:
        main.setdefault(r.name, []).append(int(np.argmax(r.topics)))
    best = {name: max(set(v), key=v.count) for name, v in main.items()}
    if bag_tables.BLOCK > 5:  # one step a pass takes more passes to tell the topics apart
        assert len(set(best.values())) == 3
        assert sum(t == best[n] for n, v in main.items() for t in v) > 140
    model.save(str(tmp_path / "m"))
    again = TopicModel.load(str(tmp_path / "m")).shares(bags, "doc").collect()
    assert np.allclose([r.topics for r in sorted(again, key=lambda r: r.doc)], [r.topics for r in sorted(rows, key=lambda r: r.doc)])


def test_vectors_are_the_leading_directions(docs, terms, bags, tmp_path):
    model = fit_vectors(bags, terms, "doc", 153, size=3, passes=5, spare=6)
    df = np.array([r.df for r in terms.orderBy("term_id").collect()])
    dense = np.log1p(matrix(docs, terms)) * np.log(154 / (df + 1))
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.strengths, s[:3], rtol=1e-4)
    rows = {r.doc: r.vector for r in model.vectors(bags, "doc").collect()}
    want = u[:, :3] * s[:3]
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = np.array([rows[i] for i in range(150)])
    assert np.allclose(np.abs(got), np.abs(want[:150]), atol=2e-3)
    model.save(str(tmp_path / "v"))
    again = {r.doc: r.vector for r in VectorModel.load(str(tmp_path / "v")).vectors(bags, "doc").collect()}
    assert all(np.allclose(again[i], rows[i]) for i in rows)


def test_rank_below_the_size(spark, terms):
    few = spark.createDataFrame([(0, ["bank", "loan"]), (1, ["bank"])], "doc long, tokens array<string>")
    names = number_terms(document_frequency(few))
    rows = packed(few, names, "doc")
    model = fit_vectors(rows, names, "doc", 5, size=4)
    got = model.vectors(rows, "doc").collect()
    assert len(got) == 2 and np.isfinite([r.vector for r in got]).all() and model.strengths[2] < 1e-6


def test_bags_stay_in_their_buckets(docs, terms):
    rows = packed(docs, terms, "doc")
    assert docs.sparkSession.catalog.listTables() == []
    state = rows.groupBy("doc").agg(F.sum(F.size("ids")).alias("n"))
    plan = rows.join(state, "doc").hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_counting_in_tasks_and_by_joins_agree(docs, terms, monkeypatch):
    rows = lambda: sorted(map(str, packed(docs, terms, "doc").collect()))
    monkeypatch.setattr(bag_tables, "BLOCK", 5)
    here = rows()
    monkeypatch.setattr(bag_tables, "IN_TASK", 1)
    assert len(here) > 150 and here == rows()


def test_an_empty_vocabulary_is_refused(docs, terms):
    with pytest.raises(ValueError):
        fit_topics(packed(docs, terms, "doc"), terms.limit(0), "doc")
    with pytest.raises(ValueError):
        fit_vectors(packed(docs, terms, "doc"), terms.limit(0), "doc", 1)


def test_a_sweep_sums_every_entry_once(docs, terms, bags):
    rows = term_places(terms).select("block", "id", F.array(F.col("term_id").cast("double"), F.lit(1.0)).alias("weights"))
    path = write_weights(rows, "given")
    found = projected(bags, "doc", path, 2, 2 if bag_tables.BLOCK == 5 else 1).collect()
    dense = np.log1p(matrix(docs, terms))
    assert all(np.allclose(r.vector, [dense[r.doc] @ np.arange(dense.shape[1]), dense[r.doc].sum()]) for r in found) and len(found) == 150


def test_topics_of_many_blocks_equal_those_of_one(docs, terms, monkeypatch, spark):
    whole = packed(docs, terms, "doc")
    one = fit_topics(whole, terms, "doc", k=3, passes=3, watch=True)
    shares = {r.doc: r.topics for r in one.shares(whole, "doc").collect()}
    monkeypatch.setattr(bag_tables, "BLOCK", 5)
    cut = packed(docs, terms, "doc")
    many = fit_topics(cut, terms, "doc", k=3, passes=3, watch=True)
    found = many.shares(cut, "doc")
    assert many.blocks > 3 and np.allclose(many.bounds, one.bounds)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]  # nothing to add up by document
    assert all(np.allclose(r.topics, shares[r.doc]) for r in found.collect()) and len(shares) == 150
