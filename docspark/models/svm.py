"""Kernel support vector classification: linear machines on random Fourier features.

An approximation of the kernel solver, linear in the number of rows; results are not numerically
equal to an exact solver's.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docspark.functions.scores import argmax
from docspark.models.features import fourier_weights, gamma_scale

FOURIER_SIZE = 256


class KernelMachine(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Feature vector -> class index, with Fourier map and all machines as two matrix products.

    Scheme ``rest`` takes the class of the largest margin, ``pairs`` the class with the most wins
    over the pairs (a, b), a < b; the first class on ties.
    """

    numFeatures = Param(Params._dummy(), "numFeatures", "Fourier features", TypeConverters.toInt)
    inputSize = Param(Params._dummy(), "inputSize", "input size", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    scheme = Param(Params._dummy(), "scheme", "rest or pairs", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "machines by row, flattened", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one per machine", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, seed=7, numFeatures=None, inputSize=None, gamma=None,
        classes=None, scheme=None, weights=None, intercepts=None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.numFeatures), self.getOrDefault(self.inputSize)
        projection, offsets = fourier_weights(size, width, self.getOrDefault(self.gamma), self.getSeed())
        machines = np.array(self.getOrDefault(self.weights)).reshape(-1, size)
        intercepts = np.array(self.getOrDefault(self.intercepts))
        classes = self.getOrDefault(self.classes)
        pairs = self.getOrDefault(self.scheme) == "pairs"
        first, second = zip(*combinations(range(classes), 2))

        def load():
            def predict(vectors: np.ndarray) -> np.ndarray:
                mapped = np.sqrt(2.0 / size) * np.cos(vectors.astype("float64") @ projection.T + offsets)
                margins = mapped @ machines.T + intercepts
                if not pairs:
                    return margins
                wins = np.zeros((len(vectors), classes))
                for column, (a, b) in enumerate(zip(first, second)):
                    won = margins[:, column] > 0
                    wins[:, a] += won
                    wins[:, b] += ~won
                return wins

            return predict

        scores = predict_batch_udf(
            load, return_type=ArrayType(DoubleType()), batch_size=4096, input_tensor_shapes=[[width]]
        )
        rows = dataset.withColumn("_margins", scores(vector_to_array(F.col(self.getInputCol()))))
        return rows.withColumn(self.getOutputCol(), argmax(F.col("_margins")).cast("double")).drop("_margins")


def sign_matrix(classes: int, scheme: str) -> np.ndarray:
    """What every machine wants of every class: 1, -1, or 0 where it does not look at the class."""
    if scheme == "rest":
        return 2.0 * np.eye(classes) - 1.0
    if scheme != "pairs":
        raise ValueError(f"unknown scheme {scheme!r}")
    signs = np.zeros((classes, classes * (classes - 1) // 2))
    for column, (a, b) in enumerate(combinations(range(classes), 2)):
        signs[a, column], signs[b, column] = 1.0, -1.0
    return signs


def hinge_sums(rows: DataFrame, machines: np.ndarray, projection: np.ndarray, offsets: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Squared hinge loss and its gradient for all machines, summed over ``label, features``: a row per machine.

    One scan: features are mapped, every machine's margin is one column of a matrix product, and a task
    sends one row of sums. ``machines`` has the intercept in the last column.
    """
    size = len(offsets)

    def sums(batches):
        total = np.zeros((len(machines), size + 2))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                label = part.column(0).to_numpy(zero_copy_only=False).astype("int64")
                vectors = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                mapped = np.ones((part.num_rows, size + 1))
                mapped[:, :size] = np.sqrt(2.0 / size) * np.cos(vectors @ projection.T + offsets)
                wanted = signs[label]
                short = np.maximum(0.0, 1.0 - wanted * (mapped @ machines.T)) * (wanted != 0)
                total[:, 0] += 0.5 * (short**2).sum(axis=0)
                total[:, 1:] -= (short * wanted).T @ mapped
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["values"])

    long = rows.mapInArrow(sums, "values array<double>").select(F.posexplode("values").alias("place", "value"))
    out = np.zeros(len(machines) * (size + 2))
    for row in long.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[row.place] = row.value
    return out.reshape(len(machines), -1)


def descent_direction(gradient: np.ndarray, past: list) -> np.ndarray:
    """The two-loop recursion over the last steps and gradient changes of one machine."""
    q, saved = gradient.copy(), []
    for s, y in reversed(past):
        rho = 1.0 / (y @ s)
        alpha = rho * (s @ q)
        q -= alpha * y
        saved.append((rho, alpha, s, y))
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for rho, alpha, s, y in reversed(saved):
        q += (alpha - rho * (y @ q)) * s
    return -q


def fit_machines(evaluate, machines: int, width: int, max_iter: int, tolerance: float = 1e-3, memory: int = 10) -> np.ndarray:
    """Minimise all machines' losses side by side by limited-memory quasi-Newton steps.

    ``evaluate(points)`` gives loss and gradient of every machine at its own point in one scan. A
    machine whose step is too long halves it while the others go on, so a scan serves all.
    """
    point, past = np.zeros((machines, width)), [[] for _ in range(machines)]
    loss, gradient = evaluate(point)
    start = np.maximum(np.abs(gradient).max(axis=1), 1e-12)
    direction = -gradient
    length = np.minimum(1.0, 1.0 / np.maximum(np.linalg.norm(gradient, axis=1), 1e-12))
    for _ in range(max_iter):
        going = np.abs(gradient).max(axis=1) > tolerance * start
        if not going.any():
            break
        trial = point + np.where(going, length, 0)[:, None] * direction
        new_loss, new_gradient = evaluate(trial)
        for m in np.flatnonzero(going):
            if new_loss[m] > loss[m] + 1e-4 * length[m] * (gradient[m] @ direction[m]):
                length[m] *= 0.5
                continue
            step, change = trial[m] - point[m], new_gradient[m] - gradient[m]
            if step @ change > 1e-12:
                past[m] = [*past[m], (step, change)][-memory:]
            point[m], loss[m], gradient[m] = trial[m], new_loss[m], new_gradient[m]
            direction[m], length[m] = descent_direction(gradient[m], past[m]), 1.0
    return point


def fit_kernel_svm(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    output: str = "class",
    gamma: float | None = None,
    size: int = FOURIER_SIZE,
    cost: float = 1.0,
    scheme: str = "rest",
    max_iter: int = 30,
    seed: int = 7,
) -> KernelMachine:
    """Fit on a feature vector and class indexes 0..k-1 (as doubles, k >= 2).

    ``gamma`` defaults to ``1 / (d * var)``. ``scheme="rest"`` fits one machine per class,
    ``"pairs"`` one per pair of classes on the rows of the two, as the exact solver does. All machines
    are fitted at once: each of at most ``max_iter`` steps reads the rows once, whatever their
    number, and nothing of the mapped features is kept.
    """
    counts = {int(row[label]): row["count"] for row in df.groupBy(label).count().collect()}
    classes = max(counts) + 1
    width = len(df.select(features).first()[0])
    gamma = gamma_scale(df, features) if gamma is None else gamma
    projection, offsets = fourier_weights(size, width, float(gamma), seed)
    signs = sign_matrix(classes, scheme)
    rows_of = np.array([counts.get(c, 0) for c in range(classes)]) @ (signs != 0)
    penalty = 1.0 / (np.maximum(rows_of, 1) * cost)
    rows = df.select(F.col(label).cast("double").alias("label"), vector_to_array(F.col(features)).alias("features"))

    def evaluate(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = hinge_sums(rows, points, projection, offsets, signs) / np.maximum(rows_of, 1)[:, None]
        weights = points.copy()
        weights[:, -1] = 0.0
        return sums[:, 0] + 0.5 * penalty * (weights**2).sum(axis=1), sums[:, 1:] + penalty[:, None] * weights

    machines = fit_machines(evaluate, signs.shape[1], size + 1, max_iter)
    return KernelMachine(
        inputCol=features,
        outputCol=output,
        seed=seed,
        numFeatures=size,
        inputSize=width,
        gamma=float(gamma),
        classes=classes,
        scheme=scheme,
        weights=[float(w) for w in machines[:, :-1].ravel()],
        intercepts=[float(b) for b in machines[:, -1]],
    )
