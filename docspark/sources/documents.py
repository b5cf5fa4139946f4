"""The document table: CSV with a fixed header, Parquet between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

# Fixed header of the document CSV. Target ids stay strings: leading zeros matter.
DOCUMENT_COLUMNS = ("sources", "categories", "subcategories", "targetids")
DOCUMENT_SCHEMA = StructType([StructField(name, StringType()) for name in DOCUMENT_COLUMNS])
# With a document id in front, so that rows can be traced to their texts.
KEYED_COLUMNS = ("doc_id", *DOCUMENT_COLUMNS)
KEYED_SCHEMA = StructType([StructField(name, StringType()) for name in KEYED_COLUMNS])


def write_documents_csv(df: DataFrame, path: str, columns: tuple[str, ...] = DOCUMENT_COLUMNS, mode: str = "error") -> None:
    """Header, commas, doubled quotes; further columns are left out.

    Cleaned text has no line ends, so the files can be split when read.
    """
    writer = df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_documents_csv(
    spark: SparkSession, path: str, schema: StructType = DOCUMENT_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Read by a fixed schema; a byte order mark is dropped. ``multi_line`` admits quoted line ends."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.option("multiLine", multi_line).csv(path)
