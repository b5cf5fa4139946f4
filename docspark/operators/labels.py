"""Category labels: index, repair of aliases, encoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.numbering import number_rows

#: Classes that a model may have: its weights hold a column for each.
MAX_CLASSES = 1_000

# Inconsistent category names and the names that replace them.
CATEGORY_ALIASES = {"medicaldevices": "medicaldevice", "lifesciences-PFA": "lspfa"}


def repair_category(category: Column, aliases: Mapping[str, str] = CATEGORY_ALIASES) -> Column:
    """Replace known aliases; other names pass through."""
    for alias, name in aliases.items():
        category = F.when(category == alias, name).otherwise(category)
    return category


def label_index(df: DataFrame, category: str) -> DataFrame:
    """``label_id, label``: the sorted distinct categories, however many, numbered from 0."""
    names = df.select(F.col(category).alias("label")).where("label IS NOT NULL").distinct()
    return number_rows(names, [F.asc("label")], "label_id").select("label_id", "label")


def fit_labels(df: DataFrame, category: str, max_classes: int = MAX_CLASSES) -> list:
    """The sorted distinct categories as a list; fails when there are too many to be classes."""
    rows = df.select(category).filter(F.col(category).isNotNull()).distinct().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{category} has more than {max_classes} distinct values")
    return sorted(row[0] for row in rows)


def label_array(labels: list) -> Column:
    """The fitted labels as an array literal."""
    return F.array(*[F.lit(label) for label in labels])


def encode_label(category: Column, labels: list) -> Column:
    """0-based index among the fitted labels; null for an unknown category."""
    return F.nullif(F.array_position(label_array(labels), category).cast("int"), F.lit(0)) - 1


def class_counts(df: DataFrame, category: str) -> DataFrame:
    """Documents per category."""
    return df.groupBy(category).agg(F.count("*").alias("n_docs"))
