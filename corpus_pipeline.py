"""From raw documents to token files: the stages of the training-text pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, minhash, mixing, token_files, toxicity
from docspark.llm.common import table
from docspark.llm.queries import REJECT, tokenizer_path
from docspark.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit severity grades on the labelled documents among ``docs``; documents of the highest grade go.

    Null and empty texts have no words and stay; repeated rows stay or go together; without labels, and on an empty
    table, nothing is rejected. Columns of any name pass through.
    """
    model = toxicity.fit_from_labels(docs, toxicity.graded_labels(table(spark, sf_dir, "labels")))
    name = "_toxicity" + "_" * max(map(len, docs.columns))  # longer than any column's name
    scored = toxicity.with_severity(docs, model, name=name)
    return scored.where(F.col(name)["top"] < REJECT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the smallest id, of rows that agree in id and text one.

    Null, empty and blank texts have no shingles and stay, a row for each id. An empty table stays empty.
    """
    return minhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none, repeated rows stay or go together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; a null source is one of its own, texts without words may go."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document in them, in the order of ids, null first. A null text is the end id alone."""
    return token_files.token_report(spark, docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: The stages fit models and sign documents; SQL cannot state that, tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
