from collections import Counter

import pytest

from docspark.operators.lookup import lookup_terms
from docspark.operators.vocabulary import (
    bag_of_words,
    document_frequency,
    frequent_terms,
    number_terms,
    prune_terms,
    top_terms,
)

DOCS = [(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["a", "b", "d"]), (4, []), (5, ["c", "zz"]), (6, ["b"])]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")


def test_document_frequency(docs):
    counts = Counter(term for _, tokens in DOCS for term in set(tokens))
    assert {row.term: row.df for row in document_frequency(docs).collect()} == counts


def test_prune_then_keep_then_number(docs):
    frequencies = document_frequency(docs)
    pruned = prune_terms(frequencies, 6, min_docs=2, max_share=0.5, keep=2)
    assert [tuple(row) for row in number_terms(pruned).orderBy("term_id").collect()] == [(0, "a", 3), (1, "b", 3)]
    assert [row.term for row in prune_terms(frequencies, 5, min_docs=2, max_share=0.5).collect()] == ["c"]
    assert [row.term for row in top_terms(frequencies, 4).collect()] == ["a", "b", "c", "d"]


def test_bag_of_words_drops_unknown_terms(docs):
    terms = number_terms(prune_terms(document_frequency(docs), 6, min_docs=2, max_share=1.0))
    rows = {(row.doc_id, row.term_id): row.tf for row in bag_of_words(docs, terms, "doc_id").collect()}
    assert rows == {(1, 0): 2, (1, 1): 1, (2, 0): 1, (2, 2): 1, (3, 0): 1, (3, 1): 1, (5, 2): 1, (6, 1): 1}


def test_lookup(spark):
    rows = [(i, [f"t{(i * j) % 7}" for j in range(i % 5)]) for i in range(50)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    table = spark.createDataFrame([("t0", 10), ("t3", 13)], "term string, value int")
    found = lookup_terms(docs, ["doc_id"], "tokens", table, "ids", missing=3)
    known = {"t0": 10, "t3": 13}
    expected = {i: None if tokens is None else [known.get(t, 3) for t in tokens] for i, tokens in rows}
    assert {row.doc_id: row.ids for row in found.collect()} == expected
    lemmas = spark.createDataFrame([("t1", "one"), ("t2", "two")], "term string, value string")
    found = lookup_terms(docs, ["doc_id"], "tokens", lemmas, "lemmas")
    names = {"t1": "one", "t2": "two"}
    expected = {i: None if tokens is None else [names.get(t, t) for t in tokens] for i, tokens in rows}
    assert {row.doc_id: row.lemmas for row in found.collect()} == expected


def test_join_lookup_with_a_term_in_most_of_the_text(spark):
    def token(i, j):
        return f"t{(i * 31 + j * j) % 3000}" if j % 2 else ("hot" if j % 4 else "gone")

    rows = [(i, [token(i, j) for j in range(40)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    table = spark.createDataFrame([("hot", 1)] + [(f"t{j}", j + 10) for j in range(0, 3000, 2)], "term string, value int")
    known = {row.term: row.value for row in table.collect()}
    found = lookup_terms(docs, ["doc_id"], "tokens", table, "ids", missing=0)
    assert {row.doc_id: row.ids for row in found.collect()} == {i: [known.get(t, 0) for t in tokens] for i, tokens in rows}


def test_lookup_of_null_and_repeated_keys_and_terms(spark):
    rows = [(None, ["a", "x"]), (None, None), (7, ["a"]), (7, ["b"]), (7, ["b"]), (8, [None, "a"]), (9, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "term string, value int")
    found = lookup_terms(docs, ["doc_id"], "tokens", table, "ids", missing=3).collect()
    expected = [(None, [1, 3]), (None, None), (7, [1]), (7, [2]), (7, [2]), (8, [3, 1]), (9, [])]
    assert sorted(((r.doc_id, r.ids) for r in found), key=str) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        lookup_terms(docs, ["doc_id"], "tokens", table.unionByName(table), "ids", missing=3)


def test_vectors_know_every_term_that_occurs_three_times(spark):
    """Terms of few documents, and of more than half of them, which the topics' vocabulary leaves out."""
    from docspark.registry.queries import document_vectors

    rows = [(i, ["all", "even" if i % 2 else "odd"]) for i in range(40)]
    rows += [(40, ["twice", "twice", "thrice"]), (41, ["thrice", "thrice"]), (42, ["one", "one", "one"]), (43, ["twice"[:4], "two"]), (44, []), (45, None), (46, [None, None, None])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    found = {r.term: r.df for r in frequent_terms(docs).collect()}
    assert found == {"all": 40, "even": 20, "odd": 20, "thrice": 2, "one": 1}
    assert {r.term for r in frequent_terms(docs, min_count=2).collect()} == set(found) | {"twice"}
    vectors = {r.doc_id: r.vector for r in document_vectors(docs, docs).collect()}
    assert sorted(i for i in vectors if i > 39 and any(vectors[i])) == [40, 41, 42] and len(vectors) == 47
    assert all(any(vectors[i]) for i in range(40))
