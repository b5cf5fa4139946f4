import collections

import duckdb
import pytest
from odd_rows import ODD

import corpus_pipeline
from docspark.llm import decontaminate
from docspark.llm.queries import ORACLE, QUERIES
from docspark.registry.compare import normal

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    mine, theirs = normal(QUERIES[name](spark, FOLDER).toPandas()), normal(duck.execute(ORACLE[name]).df())
    assert list(mine.columns) == list(theirs.columns) and len(mine) == len(theirs)
    for column in mine.columns:
        assert ((mine[column] == theirs[column]) | (mine[column].isna() & theirs[column].isna())).all(), column


def test_every_operator_has_a_query():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = docs.collect()
        assert all(r == rows[r.doc_id] for r in got)
        ids = collections.Counter(r.doc_id for r in got)
        sizes.append(len(got))
        if name == "toxicity":
            assert len(toxic - ids.keys()) > 0.5 * len(toxic) and len(got) > 900
        if name == "near_duplicates":
            assert len({r.text for r in got}) == len(got)
        if name == "decontamination":
            items = duck.execute("SELECT text FROM benchmark").fetchall()
            assert not any(t in r.text for r in got for (t,) in items)
            once = sum(len(r.text.split()) for r in got)
        if name == "mixing":
            assert max(ids.values()) == 2
            assert abs(sum(len(r.text.split()) for r in got) - 1.5 * once) < 0.1 * once
    tokens = corpus_pipeline.write_tokens(spark, docs, FOLDER).collect()
    assert collections.Counter(r.doc_id for r in tokens) == ids
    ends = sorted((r.start, r.start + r.n_tokens) for r in tokens)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert decontaminate.THRESHOLD <= decontaminate.OVERLAP


@pytest.fixture()
def folder(spark, tmp_path):
    def make(rows, extra=()):
        docs = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
        for name in extra:
            docs = docs.selectExpr("*", f"'other' AS `{name}`")
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality long, toxic long")
        labels.write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame([(1, "one two three four five six. seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return make


def test_odd_rows_and_clashing_names(spark, folder):
    rows = [r for r in ODD if r[0] is not None or r[1] is not None]
    path = folder(rows, ["_toxicity", "toxicity", "text_key", "row", "a.b"])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        assert docs.columns == before
        assert {r["a.b"] for r in docs.collect()} == {"other"}
    tokens = corpus_pipeline.write_tokens(spark, docs, path)
    assert tokens.count() == docs.count() > 0
    kept = {r.doc_id for r in docs.collect()}
    assert 6 in kept and len(kept & {1, 2}) <= 1


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0
