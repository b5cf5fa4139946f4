"""Fixed-length sequences per document or per sentence, scoring, and the document vote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.scores import argmax, cross_entropy, decode_label, one_hot, target_index
from docspark.functions.sequences import FIRST_ID, UNK, pad_sequence
from docspark.functions.tokens import as_text, first_words, sentences, words
from docspark.operators.evaluate import classification_report, confusion_matrix, majority_vote, mean_loss, pair_counts
from docspark.operators.labels import encode_label, fit_labels, label_array
from docspark.operators.lookup import lookup_terms
from docspark.operators.vocabulary import document_frequency, number_terms, top_terms
from docspark.session import materialize


def word_vocabulary(docs: DataFrame, text: str, keep: int | None = None) -> DataFrame:
    """``term, value``: all words, or the ``keep`` most frequent, with ids by frequency after those of the markers."""
    frequencies = document_frequency(docs.select(words(F.col(text)).alias("tokens")))
    kept = frequencies if keep is None else top_terms(frequencies, keep)
    return number_terms(kept, FIRST_ID).select("term", F.col("term_id").alias("value"))


def word_ids(rows: DataFrame, text: str, keys: list[str], vocabulary: DataFrame, max_len: int | None) -> DataFrame:
    """``keys, ids``: the ids of the words that fit between the two markers, or of all words without a length.

    Words beyond the length are cut before the lookup, which treats every word by itself.
    """
    kept = words(as_text(F.col(text))) if max_len is None else first_words(as_text(F.col(text)), max_len - 2)
    first = rows.select(*keys, kept.alias("_words"))
    return lookup_terms(first, keys, "_words", vocabulary, "_words", missing=UNK).withColumnRenamed("_words", "ids")


def sequence_rows(rows: DataFrame, text: str, keys: list[str], vocabulary: DataFrame, max_len: int) -> DataFrame:
    """``keys, ids, mask, token_type_ids``, one row per input row."""
    ids = word_ids(rows, text, keys, vocabulary, max_len)
    return ids.select(*keys, pad_sequence(F.col("ids"), max_len).alias("sequence")).select(*keys, "sequence.*")


def sentence_rows(docs: DataFrame, key: str, text: str, protect: tuple[str, ...] = ()) -> DataFrame:
    """``key, pos, sentence``, one row per sentence; a document without sentences has one null row."""
    split = sentences(as_text(F.col(text)), protect)
    return docs.select(key, F.posexplode_outer(split).alias("pos", "sentence"))


def vote_by_sentence(
    docs: DataFrame, key: str, text: str, score: Callable[[DataFrame], DataFrame], protect: tuple[str, ...] = ()
) -> DataFrame:
    """Score every sentence and vote per document; a document without sentences gets null.

    ``score`` turns rows ``key, pos, sentence`` into rows with ``key, pos, label``; what it makes of the
    null sentence of an empty document does not count.
    """
    scored = score(sentence_rows(docs, key, text, protect))
    scored = scored.withColumn("label", F.when(F.col("pos").isNotNull(), F.col("label")))
    return majority_vote(scored, key, "label", "pos")


def score_sequences(sequences: DataFrame, scorer: Callable[[Column, Column, Column], Column], output: str = "scores") -> DataFrame:
    """Apply a scorer of the three sequence columns to every row."""
    return sequences.withColumn(output, scorer(F.col("ids"), F.col("mask"), F.col("token_type_ids")))


class SequenceModel:
    """What a validation of the sequence flow needs: fitted labels, vocabulary and head, kept together.

    The head is a softmax over hashed ids of the fixed-length sequence, a stand-in for an encoder.
    """

    def __init__(self, labels: list[str], vocabulary: DataFrame, head: PipelineModel, max_len: int):
        self.labels = labels
        self.vocabulary = vocabulary
        self.head = head
        self.max_len = max_len

    def sequences(self, rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
        return sequence_rows(rows, text, keys, self.vocabulary, self.max_len)

    def transform(self, rows: DataFrame, text: str, keys: list[str], output: str = "scores") -> DataFrame:
        """``keys, scores``: the logarithms of the class probabilities of every row."""
        scored = self.head.transform(_pieces(self.sequences(rows, text, keys)))
        logs = F.transform(vector_to_array("_probability"), lambda p: F.log(F.greatest(p, F.lit(1e-300))))
        return scored.select(*keys, logs.alias(output))

    def save(self, path: str) -> None:
        """Write labels, vocabulary and head below ``path``."""
        rows = [(i, label, self.max_len) for i, label in enumerate(self.labels)]
        saved = self.vocabulary.sparkSession.createDataFrame(rows, "id int, label string, max_len int")
        saved.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.head.write().overwrite().save(f"{path}/head")

    @classmethod
    def load(cls, path: str) -> SequenceModel:
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{path}/labels").orderBy("id").collect()
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return cls([row.label for row in rows], vocabulary, PipelineModel.load(f"{path}/head"), rows[0].max_len)


def _pieces(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("_pieces", F.transform("ids", lambda i: i.cast("string")))


def fit_sequences(
    docs: DataFrame, text: str, category: str, key: str, max_len: int, features: int = 1 << 12, max_iter: int = 15
) -> SequenceModel:
    """Fit labels, vocabulary and head on labelled documents; the sequences are written once."""
    labels = fit_labels(docs, category)
    vocabulary = materialize(word_vocabulary(docs, text), "vocabulary")
    known = docs.withColumn("_label", encode_label(F.col(category), labels).cast("double")).where("_label IS NOT NULL")
    rows = sequence_rows(known, text, [key, "_label"], vocabulary, max_len).select("ids", "_label")
    rows = _pieces(materialize(rows, "sequences"))
    hashed = HashingTF(inputCol="_pieces", outputCol="_features", numFeatures=features)
    softmax = LogisticRegression(
        featuresCol="_features", labelCol="_label", predictionCol="_class", rawPredictionCol="_raw",
        probabilityCol="_probability", family="multinomial", maxIter=max_iter, regParam=0.01,
    )
    return SequenceModel(labels, vocabulary, Pipeline(stages=[hashed, softmax]).fit(rows), max_len)


def evaluate_scores(
    scored: DataFrame, category: str, labels: list[str], scores: str = "scores", unknown: str = "class0"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean loss, report and confusion matrix of scored documents, as validation prints them.

    A category that is not among the fitted ``labels`` has no label; loss and accuracy follow ``unknown``. The
    report covers classes of truth and prediction, the matrix those of the truth. The scores are
    computed once: labels, predictions and losses are written before the three results read them.
    """
    names = label_array(labels)
    rows = scored.select(
        decode_label(encode_label(F.col(category), labels), names).alias("label"),
        decode_label(argmax(F.col(scores)), names).alias("prediction"),
        cross_entropy(F.col(scores), target_index(one_hot(F.col(category), names), unknown)).alias("loss"),
    )
    rows = materialize(rows, "scored")
    pairs = pair_counts(rows)
    return mean_loss(rows), classification_report(pairs, unknown="skip" if unknown == "skip" else "wrong"), confusion_matrix(pairs)
