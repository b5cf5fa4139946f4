"""Classifier heads on given vectors, and scoring with models from outside Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType


def fit_head(
    df: DataFrame,
    classes: int,
    features: str = "vector",
    label: str = "label",
    output: str = "class",
    kind: str = "layers",
    hidden: int | None = None,
    max_iter: int = 50,
    seed: int = 7,
) -> Model:
    """A softmax classifier over document vectors with one hidden layer, or none.

    ``kind="layers"`` has a hidden layer (as wide as the input unless ``hidden`` says otherwise)
    with sigmoid units, ``kind="softmax"`` is multinomial logistic regression. MLlib's optimisers
    stand in for a hand-written gradient loop.
    """
    width = len(df.select(features).first()[0])
    columns = dict(featuresCol=features, labelCol=label, predictionCol=output, probabilityCol="scores")
    if kind == "layers":
        layers = [width, hidden or width, classes]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, **columns).fit(df)
    if kind == "softmax":
        return LogisticRegression(family="multinomial", maxIter=max_iter, **columns).fit(df)
    raise ValueError(f"unknown kind {kind!r}")


def sequence_scorer(load: Callable[[], Callable[..., np.ndarray]], max_len: int, batch_size: int = 64):
    """A function of ``(ids, mask, token_type_ids)`` columns that gives class scores per row.

    ``load`` runs once per worker and returns a function from the three integer matrices of a batch
    to a matrix of scores, e.g. around an encoder with its head.
    """
    return predict_batch_udf(
        load, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[max_len]] * 3
    )
