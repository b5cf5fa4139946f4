"""Topic and vector features -> kernel classifier: fit, save, load, apply, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.tokens import ENGLISH_STOP_WORDS, filter_tokens
from docspark.models.bags import packed
from docspark.models.features import drop_small
from docspark.models.svm import KernelMachine, fit_kernel_svm
from docspark.models.topics import TOPICS, TopicModel, fit_topics
from docspark.models.vectors import VECTOR_SIZE, VectorModel, fit_vectors
from docspark.operators.evaluate import classification_report, confusion_matrix, pair_counts
from docspark.operators.labels import encode_label, fit_labels, label_array
from docspark.operators.lookup import lookup_terms
from docspark.operators.vocabulary import document_frequency, number_terms, prune_terms
from docspark.session import materialize

#: Number of a row, by which its features are joined.
ROW = "_row"


class DomainModel:
    """Fitted labels, topics, vectors and kernel machine."""

    def __init__(self, topics: TopicModel, vectors: VectorModel, machine: KernelMachine, labels: list[str]):
        self.topics, self.vectors, self.machine, self.labels = topics, vectors, machine, labels

    def transform(self, docs: DataFrame, output: str = "prediction") -> DataFrame:
        """Replace ``tokens`` by the predicted category of each row."""
        rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "tokens")
        found = document_features(rows, packed(rows, self.topics.terms, ROW), self.topics, self.vectors)
        label = F.get(label_array(self.labels), F.col("class").cast("int"))
        kept = [name for name in docs.columns if name != "tokens"]
        return self.machine.transform(found).select(*kept, label.alias(output))

    def save(self, path: str) -> None:
        """Write the models and the label list below ``path``."""
        self.topics.save(f"{path}/topics")
        self.vectors.save(f"{path}/vectors")
        self.machine.write().overwrite().save(f"{path}/machine")
        rows = SparkSession.getActiveSession().createDataFrame(list(enumerate(self.labels)), "id int, label string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> DomainModel:
        rows = SparkSession.getActiveSession().read.parquet(f"{path}/labels").orderBy("id").collect()
        topics, vectors = TopicModel.load(f"{path}/topics"), VectorModel.load(f"{path}/vectors")
        return cls(topics, vectors, KernelMachine.load(f"{path}/machine"), [row.label for row in rows])


def document_tokens(
    docs: DataFrame,
    text: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    keys: Sequence[str] = (),
    max_tokens: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``tokens``: the filtered tokens, each replaced by its lemma where ``lemmas(term, value)`` has it.

    ``keys`` tell the rows apart; they are needed with lemmas only.
    """
    rows = docs.withColumn("tokens", filter_tokens(F.col(text), stop_words, max_tokens, max_chars))
    return rows if lemmas is None else lookup_terms(rows, list(keys), "tokens", lemmas, "tokens")


def document_features(rows: DataFrame, bags: DataFrame, topics: TopicModel, vectors: VectorModel) -> DataFrame:
    """Put ``features`` in place of ``tokens``: topic scores followed by the document vector.

    Both are joined by the row's number. Documents without a term of the vocabulary have even topics and a zero vector.
    """
    k = len(topics.totals)
    even = F.array_repeat(F.lit(1.0 / k), k)
    zero = F.array_repeat(F.lit(0.0), vectors.size)
    found = rows.drop("tokens").join(topics.shares(bags, ROW).withColumnRenamed("topics", "_topics"), ROW, "left")
    found = found.join(vectors.vectors(bags, ROW).withColumnRenamed("vector", "_vector"), ROW, "left")
    features = F.concat(drop_small(F.coalesce("_topics", even)), F.coalesce("_vector", zero))
    return found.withColumn("features", array_to_vector(features)).drop("_topics", "_vector")


def fit_domain_model(
    docs: DataFrame,
    text: str,
    category: str,
    topics: int = TOPICS,
    vector_size: int = VECTOR_SIZE,
    scheme: str = "rest",
    seed: int = 7,
    limits: dict | None = None,
    words: dict | None = None,
    **svm,
) -> DomainModel:
    """Fit on labelled documents. Tokens, bags and features are written once and read by every fit.

    ``words`` are the arguments of ``document_tokens``, ``limits`` those of the vocabulary.
    """
    labels = fit_labels(docs, category)
    known = docs.filter(F.col(category).isNotNull())
    label = encode_label(F.col(category), labels).cast("double").alias("label")
    rows = document_tokens(known, text, **(words or {})).select(label, "tokens", F.monotonically_increasing_id().alias(ROW))
    rows = materialize(rows, "tokens")
    n_docs = rows.count()
    terms = materialize(number_terms(prune_terms(document_frequency(rows), n_docs, **(limits or {}))), "terms")
    bags = packed(rows, terms, ROW)
    topic_model = fit_topics(bags, terms, ROW, topics, seed=seed)
    vector_model = fit_vectors(bags, terms, ROW, n_docs, vector_size, seed=seed)
    features = materialize(document_features(rows, bags, topic_model, vector_model).select("label", "features"), "features")
    machine = fit_kernel_svm(features, scheme=scheme, seed=seed, **svm)
    return DomainModel(topic_model, vector_model, machine, labels)


def predict_domains(docs: DataFrame, model: DomainModel, text: str, words: dict | None = None) -> DataFrame:
    """Add ``prediction`` to documents; ``words`` must be those of the fit."""
    return model.transform(document_tokens(docs, text, **(words or {})))


def evaluate_domains(predicted: DataFrame, category: str, model: DomainModel) -> tuple[DataFrame, DataFrame]:
    """Report and confusion matrix over the fitted classes, zero-filled."""
    pairs = pair_counts(predicted, category)
    return classification_report(pairs, model.labels), confusion_matrix(pairs, model.labels)
