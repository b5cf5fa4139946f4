from docspark.session import materialize
from docspark.sources.documents import DOCUMENT_COLUMNS, read_documents_csv, write_documents_csv


def test_round_trip_keeps_every_character(spark, tmp_path):
    rows = [
        ('say "hi", then go', "legal", "unknown", "007"),
        ("back\\slash \\r\\n and \\", "a,b", "x", "unknown"),
        (" spaces kept ", "#c", "'q'", "0"),
        ('"', "\\\"", "x", "1"),
    ]
    df = spark.createDataFrame(rows, list(DOCUMENT_COLUMNS)).selectExpr("*", "1 AS extra")
    path = str(tmp_path / "csv")
    write_documents_csv(df, path)
    assert sorted(tuple(row) for row in read_documents_csv(spark, path).collect()) == sorted(rows)


def test_byte_order_mark_and_quoted_line_ends(spark, tmp_path):
    path = tmp_path / "docs.csv"
    path.write_text('sources,categories,subcategories,targetids\n"a\nb",legal,unknown,0012\n', encoding="utf-8-sig")
    rows = read_documents_csv(spark, str(path), multi_line=True).collect()
    assert [tuple(row) for row in rows] == [("a\nb", "legal", "unknown", "0012")]
    path.write_text("sources,categories,subcategories,targetids\nab,legal,unknown,0012\n", encoding="utf-8-sig")
    assert [tuple(row) for row in read_documents_csv(spark, str(path)).collect()] == [("ab", "legal", "unknown", "0012")]


def test_long_fields(spark, tmp_path):
    text = "word " * 400_000
    df = spark.createDataFrame([(text, "a", "b", "c")], list(DOCUMENT_COLUMNS))
    write_documents_csv(df, str(tmp_path / "csv"))
    assert read_documents_csv(spark, str(tmp_path / "csv")).first().sources == text


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(10).selectExpr("id", "array(cast(id AS string)) AS tokens")
    saved = materialize(df, "tokens")
    assert saved.dtypes == df.dtypes and saved.count() == 10
    assert saved.inputFiles() and not df.inputFiles()
