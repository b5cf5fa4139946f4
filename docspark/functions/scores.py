"""Column expressions over score arrays, and the forward pass of a classifier head."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def argmax(scores: Column) -> Column:
    """0-based position of the largest score, the first one on ties; null for an empty array."""
    return F.nullif(F.array_position(scores, F.array_max(scores)).cast("int"), F.lit(0)) - 1


def decode_label(index: Column, labels: Column) -> Column:
    """Label at a 0-based index; null for a null index or one past the end."""
    return F.get(labels, index.cast("int"))


def one_hot(category: Column, labels: Column) -> Column:
    """0/1 array over ``labels``; a category that is not among them gives all zeros."""
    return F.transform(labels, lambda label: F.when(label.eqNullSafe(category), 1.0).otherwise(0.0))


def cross_entropy(scores: Column, target: Column) -> Column:
    """Negative log-softmax of the target position, in double precision."""
    scores = scores.cast("array<double>")
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, value: acc + F.exp(value - top))
    return top + F.log(total) - F.get(scores, target.cast("int"))


def target_index(one_hot_target: Column, unknown: str = "class0") -> Column:
    """Loss target of a one-hot row.

    For a row of zeros (a category unknown to the labels) ``class0`` takes position 0, as an argmax
    does, and ``skip`` gives null so that averages leave the row out.
    """
    if unknown not in ("class0", "skip"):
        raise ValueError(f"unknown policy {unknown!r}")
    index = argmax(one_hot_target)
    return index if unknown == "class0" else F.when(F.array_max(one_hot_target) > 0, index)


def head_forward(hidden: np.ndarray, output: np.ndarray, hidden_bias=None, output_bias=None, batch_size: int = 4096):
    """A function of a vector column: linear, ReLU, linear (dropout is the identity at inference).

    ``hidden`` is (width, inputs) and ``output`` (classes, width). The product of a batch of
    vectors with a matrix is one BLAS call per Arrow batch; array lambdas in the JVM would be
    interpreted value by value.
    """
    hidden, output = np.asarray(hidden, dtype="float64"), np.asarray(output, dtype="float64")
    first = np.zeros(hidden.shape[0]) if hidden_bias is None else np.asarray(hidden_bias, dtype="float64")
    second = np.zeros(output.shape[0]) if output_bias is None else np.asarray(output_bias, dtype="float64")

    def load():
        def predict(vectors: np.ndarray) -> np.ndarray:
            inner = np.maximum(vectors.astype("float64") @ hidden.T + first, 0.0)
            return inner @ output.T + second

        return predict

    return predict_batch_udf(
        load,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[hidden.shape[1]]],
    )
