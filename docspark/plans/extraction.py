"""Extraction: labelled files with segments -> one clean document per file in the wanted language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.clean import clean_text, strip_markup
from docspark.models.language import LanguageModel
from docspark.operators.rows import keep_rows
from docspark.session import spread
from docspark.sources.files import extract_trans_units, label_names, scan_labelled_files


def clean_segments(segments: DataFrame, mode: str = "reference") -> DataFrame:
    """Replace ``segment`` by its clean text and drop the empty ones."""
    text = clean_text(strip_markup(F.col("segment")), mode)
    return keep_rows(segments.withColumn("segment", text), lambda row: F.length(row["segment"]) > 0)


def segments_in_language(segments: DataFrame, model: LanguageModel, language: str, keys: list[str] | None = None) -> DataFrame:
    """Keep the segments whose top-ranked language is the wanted one; ``keys`` tell segments apart."""
    scored = model.transform(segments, "segment", "_language", keys)
    return keep_rows(scored, lambda row: row["_language"] == language).drop("_language")


def rejoin_segments(segments: DataFrame, *keys: str, text: str = "text", position: str = "pos", segment: str = "segment") -> DataFrame:
    """``keys, n_segments, text``: the segments of a file joined by a space, in their order.

    A group is one file, whose text has to be one value in any case.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(segment).alias("s"))))
    return segments.groupBy(*keys).agg(
        F.count("*").alias("n_segments"),
        F.array_join(F.transform(ordered, lambda part: part["s"]), " ").alias(text),
    )


def documents_of_files(files: DataFrame, model: LanguageModel, language: str, mode: str = "reference") -> DataFrame:
    """``doc_id, sources, categories, subcategories, targetids`` of rows ``path, name, content``.

    Files without a category, and files with no segment left, have no row. ``doc_id`` is the path.
    """
    labels = ("path", "category", "subcategory", "target_id")
    segments = clean_segments(extract_trans_units(label_names(files), "content", *labels), mode)
    documents = rejoin_segments(segments_in_language(segments, model, language, ["path", "pos"]), *labels, text="sources")
    return documents.select(
        F.col("path").alias("doc_id"),
        "sources",
        F.col("category").alias("categories"),
        F.col("subcategory").alias("subcategories"),
        F.col("target_id").alias("targetids"),
    )


def extract_documents(
    spark: SparkSession, folder: str, model: LanguageModel, language: str, mode: str = "reference"
) -> DataFrame:
    """``documents_of_files`` for a folder of labelled files."""
    return documents_of_files(spread(scan_labelled_files(spark, folder)), model, language, mode)
