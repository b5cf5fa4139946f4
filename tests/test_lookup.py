"""Lists of terms that meet a table by chunks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.models.language import fit_language_model
from docspark.models.ngram import fit_ngrams
from docspark.operators import lookup
from docspark.operators.lookup import join_terms, lookup_terms
from docspark.plans.sequence import sequence_rows, word_ids, word_vocabulary
from docspark.registry import queries
from docspark.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_terms_is_broadcast(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "b d", "y")], "doc_id long, text string, lang string")
    model = fit_language_model(docs, "text", "lang")
    table = materialize(word_vocabulary(docs, "text"), "vocabulary")
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term"))
    for df in (model.transform(docs, "text"), sequence_rows(docs, "text", ["doc_id"], table, 4), join_terms(words, table, "term", ["doc_id"])):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


@pytest.mark.parametrize("size", [1, 7, 1 << 21])
@pytest.mark.parametrize("missing", [None, "?"])
def test_lists_in_many_chunks(spark, monkeypatch, size, missing):
    monkeypatch.setattr(lookup, "CHUNK_TOKENS", size)
    rng = random.Random(size)
    rows = [(i % 9, rng.choice([None, "k"]), [rng.choice(["a", "b", "c", None, "é"]) for _ in range(rng.randrange(6))]) for i in range(40)]
    rows += [(1, None, None), (1, None, [])]
    df = spark.createDataFrame(rows, "i int, k string, tokens array<string>").repartition(3)
    table = spark.createDataFrame([("a", "1"), ("é", "2"), ("c", None), ("q", "3")], "term string, value string")
    known = {"a": "1", "é": "2"}
    found = lookup_terms(df, ["i", "k"], "tokens", table, "out", missing=missing)
    assert found.columns == ["i", "k", "tokens", "out"]
    want = [(i, k, t, None if t is None else [known.get(x, x if missing is None else missing) for x in t]) for i, k, t in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_languages_in_many_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} {'der' if i % 2 else 'the'} x{i % 3}", "de" if i % 2 else "en") for i in range(30)], "doc_id long, text string, lang string")
    model = fit_language_model(docs, "text", "lang")
    whole = sorted(model.transform(docs, "text").collect())
    monkeypatch.setattr(lookup, "CHUNK_TOKENS", 4)
    assert sorted(model.transform(docs, "text", keep=["doc_id", "text", "lang"]).collect()) == whole


def test_pairs_of_words_meet_their_counts_once(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b", "xy"[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    model = fit_ngrams(docs, "text", "lang")
    assert set(model.counts.columns) == {"gram", "n_0", "n_1"}
    found = plan(model.predict(docs, ["doc_id"], "text"))
    assert found.count("SortMergeJoin") == 1 and "FlatMapCoGroupsInArrow" in found


def test_words_of_sequences_stay_in_their_row(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b") for i in range(20)], "doc_id long, text string")
    table = materialize(word_vocabulary(docs, "text"), "vocabulary")
    for df in (sequence_rows(docs, "text", ["doc_id"], table, 4), word_ids(docs, "text", ["doc_id"], table, None)):
        assert plan(df).count("SortMergeJoin") == 1 and "FlatMapCoGroupsInArrow" in plan(df)


def test_chunks_move_packed(spark, monkeypatch):
    monkeypatch.setattr(lookup, "CHUNK_TOKENS", 1000)
    rng = random.Random(5)
    rows = [(i, [f"rather-long-word-{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 30]))]) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "i long, tokens array<string>").repartition(3)
    chunks = lookup.in_chunks(df, "tokens").collect()
    n = sum(max(1, len(t or [])) for _, t in rows)
    assert n // 1000 <= len(chunks) <= n // 1000 + 3 and len({c["_chunk"] for c in chunks}) == len(chunks)
    assert all(len(set(c.terms)) == len(c.terms) for c in chunks)
    assert sum(len(c.rows) for c in chunks) < sum(len(w) for _, t in rows for w in t or []) / 4
    table = spark.createDataFrame([("rather-long-word-7", 7)], "term string, value int")
    found = plan(lookup_terms(df, ["i"], "tokens", table, "tokens", missing=0))
    moved = [line for line in found.splitlines() if "Exchange hashpartitioning(" in line and "Exchange hashpartitioning(term" not in line]
    assert moved and "Generate explode(terms" in found and "tokens" not in "".join(moved)


def test_chunks_come_back_in_small_batches():
    rows = pa.table({"i": list(range(9))})
    lengths = np.array([3, 0, 4, 20, 1, 1, 1, 9, 2])
    found = lookup.in_batches(rows, lengths, 8)
    assert [b.column(0).to_pylist() for b in found.to_batches()] == [[0, 1, 2], [3], [4, 5, 6], [7], [8]]
    assert lookup.in_batches(rows.slice(0, 0), lengths[:0], 8).equals(rows.slice(0, 0))


def test_a_task_reads_few_chunks_and_pairs_fewer_tokens(spark, monkeypatch):
    monkeypatch.setattr(lookup, "CHUNK_TOKENS", 80)
    docs = spark.createDataFrame([(i, f"a{i} b{i % 9} c d e{i} f g h", "xy"[i % 2]) for i in range(120)], "doc_id long, text string, lang string").coalesce(1)
    lists = docs.select("doc_id", F.split("text", " ").alias("tokens"))
    assert lookup.in_chunks(lists, "tokens").count() == 12 and lookup.in_chunks(lists, "tokens", None, 8).count() == 60
    found = fit_ngrams(docs, "text", "lang").predict(docs, ["doc_id"], "text")
    moved = [line for line in plan(found).splitlines() if "hashpartitioning(_chunk#" in line]
    assert moved and all("REPARTITION_BY_NUM" in line and ", 30)" in line for line in moved)  # 60 chunks, 2 in a task
    assert found.count() == 120


def test_lemmas_travel_without_the_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "thes onen x"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.lemma_lookup(spark, str(tmp_path))
    assert {r.doc_id: r.lemmas for r in found.collect()} == {1: "the on x", 2: ""}
    back = [line for line in plan(found).splitlines() if "FlatMapCoGroupsInArrow" in line]
    assert back and all("lemmas" not in line for line in back)


def test_a_page_of_chunks_is_small(spark):
    rng = random.Random(3)
    rows = [(i, [f"{rng.randrange(1 << 60):x}" for _ in range(1 << 16)]) for i in range(8)]
    lists = spark.createDataFrame(rows, "i long, tokens array<string>").coalesce(1)
    big = lists.select("i", F.array_join("tokens", " ").cast("binary").alias("rows"))
    pages = []
    for options in ({}, lookup.PAGES):
        files = materialize(big, "pages", **options).inputFiles()
        java, conf = spark.sparkContext._jvm.org.apache, spark.sparkContext._jsc.hadoopConfiguration()
        index = java.parquet.hadoop.ParquetFileReader.open(java.parquet.hadoop.util.HadoopInputFile.fromPath(java.hadoop.fs.Path(files[0]), conf))
        pages.append(index.readOffsetIndex(index.getFooter().getBlocks().get(0).getColumns().get(1)).getPageCount())
        index.close()
    assert pages == [1, 8]
