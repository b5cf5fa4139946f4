"""Passes over bags: no table with a row per entry, and results of the plain sums."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docspark.models import bags, topics, vectors

TERMS, DOCS, EACH = 500, 2_000, 50


def entries(width, state):
    rng = np.random.default_rng(3)
    ids, counts = rng.integers(0, TERMS, DOCS * EACH).astype("int32"), rng.integers(1, 5, DOCS * EACH).astype("float64")
    part = bags.Part(np.arange(DOCS), 0, ids, counts, np.arange(DOCS + 1) * EACH, np.full((DOCS, width), state))
    return part, np.asfortranarray(rng.random((TERMS, width))), np.repeat(np.arange(DOCS), EACH)


def test_vector_pass(width=48):
    part, weights, doc = entries(width, 0.0)
    sums = {}
    tracemalloc.start()
    vectors.there_and_back(part, weights, sums)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < part.ids.size * width * 8 / 2
    state, back = np.zeros((DOCS, width)), np.zeros((TERMS, width))
    np.add.at(state, doc, np.log1p(part.counts)[:, None] * weights[part.ids])
    np.add.at(back, part.ids, np.log1p(part.counts)[:, None] * state[doc])
    assert np.allclose(part.state, state) and np.allclose(sums["terms"], back) and sums["seen"].all()


def test_topic_step(width=9):
    part, weights, doc = entries(width, 3.0)
    sums = {}
    prepare, step = topics.document_step([float(t) for t in weights.sum(axis=0)], 0.1, 2, True, True)
    beta = prepare(weights)
    gamma, theta = part.state, np.exp(topics.shares_of(part.state))
    for _ in range(2):
        norm = (theta[doc] * beta[part.ids]).sum(axis=1)
        gamma = np.zeros((DOCS, width))
        np.add.at(gamma, doc, (part.counts / norm)[:, None] * beta[part.ids])
        gamma = 0.1 + theta * gamma
        theta = np.exp(topics.shares_of(gamma))
    norm = (theta[doc] * beta[part.ids]).sum(axis=1)
    back = np.zeros((TERMS, width))
    np.add.at(back, part.ids, (part.counts / norm)[:, None] * theta[doc])
    assert np.allclose(step(part, beta, sums), gamma) and np.allclose(sums["terms"], back)
    assert np.allclose(sums["all"], (part.counts * np.log(norm)).sum())


def test_tokens_are_counted_by_slices(monkeypatch):
    monkeypatch.setattr(bags, "ENTRIES", 10)
    lists = [["a"] * n for n in (4, 5, 0, 2, 30, 1, 9, 1)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(8)), "tokens": pa.array(lists, pa.list_(pa.string()))})
    assert [some.column(0).to_pylist() for some in bags.token_slices(batch)] == [[0, 1, 2], [3], [4], [5, 6], [7]]


def test_documents_are_whole_across_batches(monkeypatch):
    monkeypatch.setattr(bags, "WHOLE", 12)
    rng = np.random.default_rng(5)
    rows = [(key, block, rng.integers(0, 5, n).tolist()) for key in range(30) for block, n in enumerate(rng.integers(1, 7, rng.integers(1, 6)))]
    columns = dict(zip(("key", "block", "ids"), map(list, zip(*rows))))
    table = pa.table({"key": columns["key"], "block": pa.array(columns["block"], pa.int32()), "ids": pa.array(columns["ids"], pa.list_(pa.int32()))})
    found = list(bags.whole_documents(iter(table.to_batches(max_chunksize=7))))
    assert pa.Table.from_batches(found).to_pylist() == table.to_pylist() and len(found) > 5
    keys = [set(some.column(0).to_pylist()) for some in found]
    assert sum(map(len, keys)) == len(set().union(*keys)) == 30
    one = max(sum(len(r[2]) for r in rows if r[0] == key) for key in range(30))
    assert all(len(some.column(2).flatten()) < 12 + 2 * one for some in found)
