import hashlib
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from docspark.operators.training_log import (
    early_stop,
    epoch_summary,
    file_batches,
    number_steps,
    running,
    shuffled_batches,
    training_curve,
)
from docspark.plans.training import stops_of_log


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_running_values_do_not_depend_on_the_partitions(spark, partitions):
    rng = random.Random(2)
    # One key holds most rows; order values have gaps.
    rows = [("hot" if rng.random() < 0.8 else rng.choice([None, "k0", "k1"]), 3 * i * 10**7, rng.randint(-5, 5)) for i in range(400)]
    rows.append((None, None, 4))
    rows = [rows[-1], *rows[:-1]]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, place long, v long").repartition(4)
    got = running(df, ["key"], "place", sums={"s": F.col("v")}, maxima={"m": F.col("v")}, partitions=partitions)
    expected = set()
    for key in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == key]
        values = [row[2] for row in mine]
        expected |= {(*row, s, m) for row, s, m in zip(mine, accumulate(values), accumulate(values, max))}
    assert {tuple(row) for row in got.select("key", "place", "v", "s", "m").collect()} == expected


def test_batches(spark):
    df = spark.range(0, 500, 5).withColumnRenamed("id", "doc_id").repartition(3)
    ids = list(range(0, 500, 5))
    in_order = {row.doc_id: row.batch_id for row in file_batches(df, "doc_id", 15).collect()}
    assert in_order == {doc: i // 15 for i, doc in enumerate(ids)}
    shuffled = sorted(ids, key=lambda i: (hashlib.md5(f"s{i}".encode()).hexdigest(), i))
    got = {row.doc_id: row.batch_id for row in shuffled_batches(df, "doc_id", 15, seed="s").collect()}
    assert got == {doc: i // 15 for i, doc in enumerate(shuffled)}


def stop_by_loop(accuracies, patience):
    peak, missed = 0.0, 0
    for place, value in enumerate(accuracies):
        if value > peak:
            peak, missed = value, 0
        else:
            missed += 1
        if missed == patience:
            return place
    return None


def test_early_stop_equals_the_loop(spark):
    rng = random.Random(4)
    runs = {i: [rng.choice([0.0, 0.1, 0.2, 0.3, 0.4]) for _ in range(rng.randint(1, 30))] for i in range(150)}
    runs[150] = [0.0] * 5
    runs[151] = [0.1, 0.1, 0.1, 0.1]
    runs[152] = [0.01 * i for i in range(1, 40)]
    rows = [(run, 10 * place + 3, value) for run, values in runs.items() for place, value in enumerate(values)]
    curve = spark.createDataFrame(rows, "run int, place long, accuracy double").repartition(3)
    for partitions in (1, 9):
        got = {row.run: (row.place - 3) // 10 for row in early_stop(curve, "run", "place", 3, partitions=partitions).collect()}
        expected = {run: stop_by_loop(values, 3) for run, values in runs.items()}
        assert got == {run: place for run, place in expected.items() if place is not None}


def test_curve_reports_and_state_across_epochs(spark):
    rng = random.Random(6)
    log, expected, place = [], [], 0
    for epoch in range(2):
        loss_sum = correct_sum = n_sum = 0
        for step in range(23):
            loss, n = rng.randint(1, 100) / 64, rng.choice([5, 5, 3])
            correct = rng.randint(0, n)
            log.append(("r", epoch, place, loss, correct, n))
            loss_sum, correct_sum, n_sum = loss_sum + loss, correct_sum + correct, n_sum + n
            if step % 10 == 0 and step:
                expected.append((epoch, step, loss_sum / (step + 1), correct_sum / n_sum))
            place += 1
    df = spark.createDataFrame(log, "run string, epoch int, place long, loss double, ok int, n int").repartition(3)
    steps = number_steps(df, ["run", "epoch"], "place", "loss", "ok", "n", partitions=8)
    curve = training_curve(steps, ["run", "epoch"], "place", 10)
    got = sorted(tuple(row) for row in curve.select("epoch", "step", "loss", "accuracy").collect())
    assert [row[:2] for row in got] == [row[:2] for row in expected]
    for mine, theirs in zip(got, expected):
        assert mine[2:] == pytest.approx(theirs[2:], abs=6e-5)
    rows = [("r", 0, 1, 0.5), ("r", 0, 2, 0.5), ("r", 1, 3, 0.4)]
    curve = spark.createDataFrame(rows, "run string, epoch int, place long, accuracy double")
    stop = early_stop(curve, "run", "place", 2)
    assert [(row.epoch, row.place, row.peak) for row in stop.collect()] == [(1, 3, 0.5)]


def test_null_runs_null_order_and_no_examples(spark):
    rows = [(None, 0, i, 0.5, 1, 0) for i in range(5)] + [("a", 0, i, 0.25, 0, 2) for i in range(4)] + [("a", 0, None, 0.25, 2, 2)]
    df = spark.createDataFrame(rows, "run string, epoch int, place long, loss double, ok int, n int").repartition(3)
    steps = number_steps(df, ["run", "epoch"], "place", "loss", "ok", "n")
    assert steps.count() == 10
    curve = {(r.run, r.step): (r.loss, r.accuracy) for r in training_curve(steps, ["run", "epoch"], "place", 2).collect()}
    assert curve == {(None, 2): (0.5, None), (None, 4): (0.5, None), ("a", 2): (0.25, 0.3333), ("a", 4): (0.25, 0.2)}
    summary = {r.run: (r.n_batches, r.loss, r.accuracy) for r in epoch_summary(df, ["run", "epoch"], "loss", "ok", "n").collect()}
    assert summary == {None: (5, 0.5, None), "a": (5, 0.25, 0.2)}
    few = spark.createDataFrame([(None,), (3,), (10**15,)], "doc_id long")
    assert {r.doc_id: r.batch_id for r in file_batches(few, "doc_id", 2).collect()} == {None: 0, 3: 0, 10**15: 1}
    assert shuffled_batches(few, "doc_id", 2).count() == 3


def test_stops_of_a_log(spark):
    """Accuracy falls after the first report, so the run stops with the second miss."""
    log = [("r", step // 30, step, 0.5, int(step < 4), 1) for step in range(60)]
    df = spark.createDataFrame(log, "run string, epoch int, place long, loss double, n_correct int, n int")
    stop = stops_of_log(df, patience=2, every=10).collect()
    assert [(row.epoch, row.step, row.place, row.accuracy, row.peak) for row in stop] == [(1, 10, 40, 0.0, 0.3636)]
