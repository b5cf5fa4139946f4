import math

import duckdb
import pytest

import __spark_entry__ as contract
from docspark.registry.compare import TABLES, normal
from docspark.registry.oracle import ORACLE
from docspark.registry.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FITTED = {"lda_topics", "doc_vectors", "svm_predict", "svm_pairs", "head_train"}


# Held-out accuracy has bars that a fit on 150 documents need not reach.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    def views(folder):
        con = duckdb.connect()
        for table in TABLES.split():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        return con

    return {folder: views(folder) for folder in (FOLDER, LARGER)}


def test_every_query_has_sql_unless_it_fits_a_model():
    assert QUERIES.keys() - ORACLE.keys() == FITTED
    assert not contract.oracle_sql().keys() - contract.queries().keys()
    assert QUERIES.keys() <= contract.queries().keys()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["page_id", "n_segments", "text"] and df.count() > 0


def equal(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a != a and b != b) or math.isclose(a, b, abs_tol=2e-6)
    return a == b or (a is None and b is None)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    folder = LARGER if name.endswith("held_out") else FOLDER
    df = contract.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan
    mine, theirs = normal(df.toPandas()), normal(duck[folder].execute(contract.oracle_sql()[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert len(mine) == len(theirs)
    for column in mine.columns:
        assert all(equal(a, b) for a, b in zip(mine[column].tolist(), theirs[column].tolist())), column
