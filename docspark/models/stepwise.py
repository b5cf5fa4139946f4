"""A classifier head trained in minibatch steps over partitions, with reports while it runs and an early stop."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.training_log import PATIENCE, REPORT_EVERY, shuffled_batches
from docspark.session import fresh_path

#: Minibatches of a step that are worked on side by side, as the original's devices share one.
SHARDS = 4
BATCH = 50
STEP_LOG = "array<struct<step: long, loss: double, n_correct: long, n: long>>"


class Head:
    """One hidden layer of rectified units and a softmax, over one flat array of weights."""

    def __init__(self, weights: np.ndarray, width: int, units: int, classes: int):
        self.weights = weights
        cut = (width + 1) * units
        self.hidden, self.output = weights[:cut].reshape(width + 1, units), weights[cut:].reshape(units + 1, classes)

    @staticmethod
    def first_weights(width: int, units: int, classes: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(scale=(2 / (width + 1)) ** 0.5, size=(width + 1) * units), rng.normal(scale=(1 / (units + 1)) ** 0.5, size=(units + 1) * classes)])

    def loss_and_gradient(self, vectors: np.ndarray, label: np.ndarray) -> tuple[float, int, np.ndarray]:
        """Mean cross entropy, how many greatest scores are the label's, and the gradient of the former."""
        rows = np.arange(len(label))
        with_one = np.hstack([vectors, np.ones((len(vectors), 1))])
        units = np.hstack([np.maximum(0, with_one @ self.hidden), np.ones((len(vectors), 1))])
        scores = units @ self.output
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        loss, right = -np.log(np.maximum(shares[rows, label], 1e-300)).mean(), (scores.argmax(axis=1) == label).sum()
        shares[rows, label] -= 1
        shares /= len(label)
        back = (shares @ self.output[:-1].T) * (units[:, :-1] > 0)
        return float(loss), int(right), np.concatenate([(with_one.T @ back).ravel(), (units.T @ shares).ravel()])

    def predict(self, vectors: np.ndarray) -> np.ndarray:
        units = np.maximum(0, vectors @ self.hidden[:-1] + self.hidden[-1])
        return (units @ self.output[:-1] + self.output[-1]).argmax(axis=1)


@dataclass
class Fit:
    """The head, its log (a row per step), and epoch and step of the report it stopped at, or None."""

    head: Head
    log: DataFrame
    stopped: tuple[int, int] | None


def laid_out(rows: DataFrame, key: str, label: str, vector: str, batch: int, every: int, shards: int, seed: int) -> str:
    """Write ``label, vector, step, shard`` with a folder per report: its step is the last of its rows'."""
    values = F.col(vector) if rows.schema[vector].dataType.typeName() == "array" else vector_to_array(vector)
    flat = rows.select(key, F.col(label).cast("int").alias("label"), values.alias("vector"))
    flat = shuffled_batches(flat, key, batch, str(seed)).select("label", "vector", F.expr(f"batch_id div {shards}").alias("step"), F.expr(f"int(batch_id % {shards})").alias("shard"))
    flat = flat.withColumn("report", F.expr(f"greatest(step - 1, 0) div {every}"))
    path = fresh_path(rows.sparkSession, "steps")
    flat.repartition("report", "shard").write.partitionBy("report").parquet(path)
    return path


def walked(rows: DataFrame, state: np.ndarray, done: int, shape: tuple[int, int, int], rate: float) -> DataFrame:
    """A row per shard after its steps: weights and running moments as one array, and the log of its steps."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        weights, mean, square = state.reshape(3, -1).copy()
        head, t, log = Head(weights, *shape), done, []
        for step, part in frame.groupby("step", sort=True):
            vectors, label = np.stack(part["vector"].to_numpy()), part["label"].to_numpy()
            loss, right, gradient = head.loss_and_gradient(vectors, label)
            log.append({"step": int(step), "loss": loss, "n_correct": right, "n": len(label)})
            t += 1
            mean[:] = 0.9 * mean + 0.1 * gradient
            square[:] = 0.999 * square + 0.001 * gradient**2
            weights -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        return pd.DataFrame({"state": [np.concatenate([weights, mean, square])], "log": [log]})

    return rows.groupBy("shard").applyInPandas(walk, f"state array<double>, log {STEP_LOG}")


def rounded(share: float) -> float:
    """To 4 decimals, as the reports of a log are rounded."""
    return float(Decimal(repr(share)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def fit_stepwise(
    rows: DataFrame,
    classes: int,
    key: str,
    label: str = "label",
    vector: str = "vector",
    units: int | None = None,
    epochs: int = 2,
    batch: int = BATCH,
    rate: float = 1e-2,
    every: int = REPORT_EVERY,
    patience: int = PATIENCE,
    shards: int = SHARDS,
    seed: int = 7,
) -> Fit:
    """Train a head and stop it by its own running accuracy.

    Rows are dealt once to steps and shards in the order of a hash of their unique ``key``, and written with a
    folder per report, so that a report is one job over its own rows: ``every`` steps of ``shards`` minibatches of
    ``batch`` rows, whatever the size of the table. Shards walk their minibatches side by side from one
    head, whose weights and moments are then averaged. As in a plain loop, a report stands at every ``every``-th step of an
    epoch but the first and has the accuracy of all its steps so far; ``patience`` reports in a row without a
    new peak, which lives on over epochs, end the fit there and then.

    The log (``run, epoch, place, step, loss, n_correct, n``, as ``plans.training`` takes it) stays in files of the
    tasks; the driver gets a report's sums and weights. Rows without a label are left out; the
    result depends on the keys, not on the cluster.
    """
    spark = rows.sparkSession
    path = laid_out(rows.where(F.col(label).isNotNull()), key, label, vector, batch, every, shards, seed)
    table = spark.read.schema("label int, vector array<double>, step long, shard int, report long").parquet(path)
    ends = sorted((r.report, r.last) for r in table.groupBy("report").agg(F.max("step").alias("last")).collect())
    if not ends:
        raise ValueError("no labelled rows to train on")
    width = len(table.select("vector").first()[0])
    shape = (width, units or width, classes)
    first = Head.first_weights(*shape, seed)
    state, done, logs = np.concatenate([first, np.zeros(2 * len(first))]), 0, fresh_path(spark, "training-log")
    peak, missed, stopped = 0.0, 0, None
    for epoch in range(epochs):
        right = n = 0
        for report, last in ends:
            path = f"{logs}/epoch={epoch}/report={report}"
            walked(table.where(F.col("report") == int(report)), state, done, shape, rate).write.parquet(path)
            found = spark.read.parquet(path)
            entries = found.select(F.posexplode("state").alias("place", "value")).groupBy("place").agg(F.avg("value").alias("value"))
            state = np.array([row.value for row in sorted(entries.collect())])
            sums = found.select(F.inline("log")).agg(F.sum("n_correct"), F.sum("n"), F.count_distinct("step")).first()
            right, n, done = right + sums[0], n + sums[1], done + sums[2]
            if last == 0 or last % every:
                continue  # the epoch's end, between two reports
            accuracy = rounded(right / n)
            peak, missed = (accuracy, 0) if accuracy > peak else (peak, missed + 1)
            if missed == patience:
                stopped = (epoch, int(last))
                break
        if stopped:
            break
    steps = spark.read.parquet(logs).select("epoch", F.inline("log"))
    mean = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    log = steps.groupBy("epoch", "step").agg(mean.alias("loss"), F.sum("n_correct").alias("n_correct"), F.sum("n").alias("n"))
    log = log.select(F.lit(0).alias("run"), "epoch", (F.col("epoch") * (ends[-1][1] + 1) + F.col("step")).alias("place"), "step", "loss", "n_correct", "n")
    return Fit(Head(state.reshape(3, -1)[0], *shape), log, stopped)
