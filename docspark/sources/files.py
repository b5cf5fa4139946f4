"""Labelled folders of segmented files: listing, labels from names, units in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.clean import decode_entities
from docspark.operators.labels import repair_category

# Fixed patterns of the file names; the first match counts.
CATEGORY = r"#category#(.+?)#"
SUBCATEGORY = r"#subcategory#(.+?)#"
TARGET_ID = r"#targetid#(\d+)"
UNKNOWN = "unknown"

UNIT = r"(?s)<(?:\w+:)?trans-unit\b.*?</(?:\w+:)?trans-unit>"
ALTERNATIVE = r"<(?:\w+:)?alt-trans[\s/>]"
EMPTY_SOURCE = r"<((?:\w+:)?source)(?:\s[^>]*)?/>"
SOURCE = r"(?s)<(?:\w+:)?source(?:\s[^>]*)?>(.*?)</(?:\w+:)?source>"
COMMENT_OUTSIDE_CDATA = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->"
CDATA_OR_TEXT = r"(?s)<!\[CDATA\[.*?\]\]>|(?:(?!<!\[CDATA\[).)+"


def scan_labelled_files(spark: SparkSession, folder: str, glob: str = "*#category#*") -> DataFrame:
    """``path, name, content`` of the files whose name carries a category; sub-folders are no files.

    The name pattern is applied while listing, so other files are never opened.
    """
    return named_text(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder))


def named_text(files: DataFrame) -> DataFrame:
    """``path, name, content`` of binary file rows, with the content as text."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), file_text("content").alias("content"))


def file_text(content: Column | str) -> Column:
    """Bytes as text: UTF-16 with a byte order mark, else UTF-8; bad bytes never fail the job.

    Files in a single-byte encoding lose their characters beyond ASCII here, which cleaning drops anyway.
    """
    content = F.col(content) if isinstance(content, str) else content
    mark = F.hex(F.substring(content, 1, 2))
    utf8 = F.make_valid_utf8(content.cast("string"))
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(utf8)


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def label_names(
    df: DataFrame,
    name: str = "name",
    category: str = CATEGORY,
    subcategory: str = SUBCATEGORY,
    target_id: str = TARGET_ID,
) -> DataFrame:
    """Add ``category, subcategory, target_id`` read from a name; rows without a category go."""
    text = F.col(name)
    return df.withColumns(
        {
            "category": repair_category(first_match(text, category)),
            "subcategory": F.coalesce(first_match(text, subcategory), F.lit(UNKNOWN)),
            "target_id": F.coalesce(first_match(text, target_id), F.lit(UNKNOWN)),
        }
    ).filter(F.col("category").isNotNull())


def extract_units(df: DataFrame, content: str, pattern: str, *keep: str, group: int = 1) -> DataFrame:
    """``keep, pos, segment``: one row per match of ``pattern``, numbered in file order."""
    found = F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(group))
    return df.select(*keep, F.posexplode(found).alias("pos", "segment"))


def unit_source(unit: Column) -> Column:
    """Text of the first ``source`` child of a unit: inline tags out, CDATA unwrapped, decoded once."""
    inner = F.regexp_extract(F.regexp_replace(unit, EMPTY_SOURCE, "<$1></$1>"), SOURCE, 1)
    parts = F.transform(
        F.regexp_extract_all(inner, F.lit(CDATA_OR_TEXT), F.lit(0)),
        lambda part: F.when(
            part.startswith("<![CDATA["),
            F.replace(
                F.replace(F.regexp_extract(part, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1), F.lit("&"), F.lit("&amp;")),
                F.lit("<"),
                F.lit("&lt;"),
            ),
        ).otherwise(F.regexp_replace(part, "<[^>]*>", "")),
    )
    return decode_entities(F.array_join(parts, ""), raw=unit)


def extract_trans_units(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``keep, pos, segment``: source texts of the translation units that hold an ``alt-trans``.

    Patterns instead of an XML parser: markup that is not well formed, which a strict parser
    would answer by failing the job, gives what can be found in it.
    """
    text = F.regexp_replace(F.col(content), COMMENT_OUTSIDE_CDATA, "$1")
    units = extract_units(df.withColumn("_text", text), "_text", UNIT, *keep, group=0)
    with_alternative = units.filter(F.col("segment").rlike(ALTERNATIVE))
    return with_alternative.withColumn("segment", unit_source(F.col("segment")))
