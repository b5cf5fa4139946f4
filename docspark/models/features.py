"""Columns of topic scores, and the random features of a kernel."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Fixed value of the original features.
MIN_TOPIC_SCORE = 0.01


def drop_small(scores: Column, least: float = MIN_TOPIC_SCORE) -> Column:
    """Set topic scores below ``least`` to zero, as a sparse listing leaves them out."""
    return F.transform(scores, lambda score: F.when(score < least, 0.0).otherwise(score))


def dense_topics(pairs: Column, k: int, least: float = MIN_TOPIC_SCORE) -> Column:
    """Array of ``k`` scores from an array of ``(topic, score)`` structs; missing topics are 0."""
    found = F.map_from_entries(pairs)
    scores = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(found[i.cast("int")], F.lit(0.0)))
    return drop_small(scores, least)


def gamma_scale(df: DataFrame, features: str) -> float:
    """``1 / (d * var)`` with the variance over all entries of all vectors, in one aggregate."""
    stats = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(features)).alias("s")).first().s
    mean, square = stats.mean.toArray().mean(), (stats.normL2.toArray() ** 2).mean() / stats["count"]
    variance = square - mean**2
    return 1.0 / (len(stats.mean) * variance) if variance > 0 else 1.0


def fourier_map(weights: np.ndarray, offsets: np.ndarray, batch_size: int = 4096):
    """A function of an array column: ``sqrt(2 / D) * cos(W x + b)``, one matrix product per batch."""
    weights, offsets = np.asarray(weights, dtype="float64"), np.asarray(offsets, dtype="float64")
    scale = np.sqrt(2.0 / len(offsets))

    def load():
        return lambda vectors: scale * np.cos(vectors.astype("float64") @ weights.T + offsets)

    return predict_batch_udf(
        load, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[weights.shape[1]]]
    )


def fourier_weights(size: int, width: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded weights (size, width) and offsets for the kernel ``exp(-gamma * |x - y|^2)``."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2.0 * gamma), size=(size, width)), rng.uniform(0.0, 2.0 * np.pi, size=size)
