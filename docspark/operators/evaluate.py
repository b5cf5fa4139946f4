"""Evaluation of predictions: votes, confusion matrices, reports, losses.

Everything starts from a partial aggregate by (label, prediction), so the rows that meet in one
task are at most one per pair of classes, however the classes are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.numbering import number_rows
from docspark.session import materialize


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n`` over all rows."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def _side(name: str, **values: Column | str) -> Column:
    """One side of a pair as a struct ``name, ...`` with nullable fields, so that sides fit one array."""
    fields = [F.col(value) if isinstance(value, str) else value for value in values.values()]
    return F.struct(F.col(name).alias("name"), *[field.alias(key) for key, field in zip(values, fields)])


def report_labels(pairs: DataFrame) -> DataFrame:
    """Every class that occurs as truth or as prediction."""
    both = pairs.select(F.explode(F.array("label", "prediction")).alias("label"))
    return both.filter(F.col("label").isNotNull()).distinct()


def unseen_predictions(pairs: DataFrame) -> DataFrame:
    """Predicted classes that no truth has, with how many rows they take out of a truth-only matrix."""
    zero = F.lit(0).cast("bigint")
    truths = _side("label", predicted=zero, true=F.lit(True))
    guesses = _side("prediction", predicted="n", true=F.lit(False))
    sides = pairs.select(F.inline(F.array(truths, guesses)))
    return (
        sides.groupBy(F.col("name").alias("prediction"))
        .agg(F.sum("predicted").alias("n"), F.bool_or("true").alias("seen"))
        .filter(~F.col("seen") & F.col("prediction").isNotNull())
        .select("prediction", "n")
    )


def _classes(pairs: DataFrame, labels: str | list) -> DataFrame:
    """``name`` of every class of the set, as a table."""
    if isinstance(labels, list):
        return pairs.sparkSession.createDataFrame([(name,) for name in labels], "name " + pairs.schema["label"].dataType.simpleString())
    names = report_labels(pairs) if labels == "union" else pairs.where("label IS NOT NULL").select("label").distinct()
    return names.withColumnRenamed("label", "name")


def confusion_matrix(pairs: DataFrame, labels: str | list = "truth") -> DataFrame:
    """``label, prediction, n`` for every pair of classes, zero-filled.

    ``labels`` is ``"truth"`` (pairs with a class that no truth has vanish), ``"union"`` or a
    fitted list. The classes are numbered; every class lists all numbers, and two joins put the names
    and the counts to them, so no task holds more than its share of the cells.
    """
    names = number_rows(_classes(pairs, labels), [F.asc("name")], "id")
    last = names.agg(F.max("id")).first()[0]
    if last is None:
        return pairs.select("label", "prediction", "n").where("false")
    cells = names.select(F.col("name").alias("label"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("id"))
    cells = cells.join(names.withColumnRenamed("name", "prediction"), "id").select("label", "prediction")
    counts = pairs.where("label IS NOT NULL AND prediction IS NOT NULL")
    found = cells.join(counts, ["label", "prediction"], "left")
    return found.select("label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_wide(pairs: DataFrame, labels: list, prefix: str = "p") -> DataFrame:
    """One row per fitted label and one column per predicted label."""
    counts = [
        F.coalesce(F.sum(F.when(F.col("prediction") == name, F.col("n"))), F.lit(0)).alias(f"{prefix}{name}")
        for name in labels
    ]
    known = pairs.filter(F.col("label").isin(labels) & F.col("prediction").isin(labels))
    empty = pairs.sparkSession.createDataFrame(
        [(name, None, 0) for name in labels], known.select("label", "prediction", "n").schema
    )
    return known.unionByName(empty).groupBy("label").agg(*counts)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def classification_report(pairs: DataFrame, labels: str | list = "union", unknown: str = "wrong") -> DataFrame:
    """``class, precision, recall, f1, support`` per class, then accuracy, macro and weighted averages.

    A metric with a zero denominator is 0. The accuracy row holds the accuracy in its three metric
    columns and its number of rows as support. A row without a known truth counts as a wrong one
    for the accuracy, or not at all with ``unknown="skip"``, as in ``accuracy``.
    """
    zero = F.lit(0).cast("bigint")
    hits = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    pairs = materialize(pairs.select("label", "prediction", "n"), "pairs")
    sides = pairs.select(
        F.inline(
            F.array(
                _side("label", support="n", predicted=zero, hits=hits),
                _side("prediction", support=zero, predicted="n", hits=zero),
            )
        )
    )
    if isinstance(labels, list):
        zeros = pairs.sparkSession.createDataFrame([(name, 0, 0, 0) for name in labels], sides.schema)
        sides = sides.filter(F.col("name").isin(labels)).unionByName(zeros)
    classes = (
        sides.filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    if labels == "truth":
        classes = classes.filter(F.col("support") > 0)
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    classes = classes.select("name", precision.alias("precision"), recall.alias("recall"), "support", "hits").withColumn(
        "f1",
        F.when(
            F.col("precision") + F.col("recall") > 0,
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
        ).otherwise(0.0),
    )
    classes = materialize(classes, "classes")
    metrics = ("precision", "recall", "f1")
    total = F.sum("support")
    lost = pairs.where("label IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if unknown == "wrong" else 0
    summary = classes.agg(
        total.alias("support"),
        (total + lost).alias("rows"),
        _ratio(F.sum("hits"), total + lost).alias("accuracy"),
        *[F.avg(metric).alias(f"macro_{metric}") for metric in metrics],
        *[_ratio(F.sum(F.col(metric) * F.col("support")), total).alias(f"weighted_{metric}") for metric in metrics],
    )

    def row(name: str, columns: list[str], support: str = "support") -> Column:
        values = [F.col(column).alias(metric) for column, metric in zip(columns, metrics)]
        return F.struct(F.lit(name).alias("class"), *values, F.col(support).alias("support"))

    extra = F.array(
        row("accuracy", ["accuracy"] * 3, "rows"),
        row("macro avg", [f"macro_{metric}" for metric in metrics]),
        row("weighted avg", [f"weighted_{metric}" for metric in metrics]),
    )
    own = classes.select(F.col("name").cast("string").alias("class"), *metrics, "support")
    return own.unionByName(summary.select(F.inline(extra)))


def accuracy(pairs: DataFrame, unknown: str = "wrong") -> DataFrame:
    """``n, n_correct, accuracy``; rows without a known truth are wrong, or left out with ``unknown="skip"``."""
    pairs = pairs if unknown == "wrong" else pairs.where("label IS NOT NULL")
    correct = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return pairs.agg(F.sum("n").alias("n"), correct.alias("n_correct"), _ratio(correct, F.sum("n")).alias("accuracy"))


def majority_vote(df: DataFrame, key: str, label: str, position: str) -> DataFrame:
    """The most frequent label per key, ties to the label met first; null if a key has no label.

    Counts are made by (key, label) before any key is gathered, so a key with very many votes
    reaches its task as one row per label.
    """
    counts = df.groupBy(key, label).agg(F.count(label).alias("votes"), F.min(position).alias("first"))
    rank = F.struct("votes", (-F.col("first")).alias("back"))
    return counts.groupBy(key).agg(
        F.max_by(F.when(F.col(label).isNotNull(), F.col(label)), rank).alias("prediction"),
        F.max("votes").alias("votes"),
    )


def mean_loss(df: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean of the per-document loss; null losses are left out."""
    return df.agg(F.count(loss).alias("n_docs"), F.avg(loss).alias("loss"))


def epoch_loss(df: DataFrame, batch: str = "batch_id", loss: str = "loss", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the batch means per ``keys``, which differs from the row mean when the last batch is short."""
    batches = df.groupBy(*keys, batch).agg(F.avg(loss).alias("batch_loss"))
    return batches.groupBy(*keys).agg(F.count("*").alias("n_batches"), F.avg("batch_loss").alias("loss"))
