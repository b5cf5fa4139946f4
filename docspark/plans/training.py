"""From the log of a training run to its curve and its stopping point."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docspark.operators.training_log import PATIENCE, REPORT_EVERY, early_stop, number_steps, training_curve
from docspark.session import materialize


def curve_of_log(
    log: DataFrame,
    run: str = "run",
    epoch: str = "epoch",
    order: str = "place",
    loss: str = "loss",
    n_correct: str = "n_correct",
    n: str = "n",
    every: int = REPORT_EVERY,
) -> DataFrame:
    """``run, epoch, order, step, loss, accuracy`` at every ``every``-th step.

    ``log`` has one row per minibatch; ``order`` is an integer that rises through all epochs of a run.
    """
    steps = number_steps(log, [run, epoch], order, loss, n_correct, n)
    return training_curve(steps, [run, epoch], order, every)


def stops_of_log(log: DataFrame, run: str = "run", order: str = "place", patience: int = PATIENCE, **columns) -> DataFrame:
    """The report at which each run stops.

    The curve, a small part of the log, is written once: the stopping rule reads it several times.
    """
    curve = materialize(curve_of_log(log, run=run, order=order, **columns), "curve")
    return early_stop(curve, run, order, patience)
