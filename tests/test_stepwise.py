import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.models.stepwise import Head, fit_stepwise, rounded
from docspark.plans.training import curve_of_log, stops_of_log


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 600)
    points = rng.normal(size=(600, 5)) + 2.5 * np.eye(5)[label]
    data = [(i, None if i % 50 == 49 else int(y), p.tolist()) for i, (y, p) in enumerate(zip(label, points))]
    return spark.createDataFrame(data, "id long, label int, vector array<double>").repartition(5).cache()


def test_gradient_of_the_head():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    weights = Head.first_weights(4, 6, 3, 1)
    gradient = Head(weights, 4, 6, 3).loss_and_gradient(x, y)[2]
    for i in range(0, len(weights), 3):
        step = np.zeros(len(weights))
        step[i] = 1e-6
        change = Head(weights + step, 4, 6, 3).loss_and_gradient(x, y)[0] - Head(weights - step, 4, 6, 3).loss_and_gradient(x, y)[0]
        assert gradient[i] == pytest.approx(change / 2e-6, abs=1e-5)


def test_it_stops_where_the_rule_on_its_log_stops(rows):
    fit = fit_stepwise(rows, 3, "id", batch=10, every=4, patience=2, shards=3, epochs=6, rate=0.2)
    stop = stops_of_log(fit.log, patience=2, every=4).collect()
    assert fit.stopped is not None and [(r.epoch, r.step) for r in stop] == [fit.stopped]
    log = fit.log.orderBy("place").collect()
    assert [r.place for r in log] == sorted({r.place for r in log})
    assert (log[-1].epoch, log[-1].step) == fit.stopped  # not a step further
    first = [r for r in log if r.epoch == 0]
    assert sum(r.n for r in first) == 588 and first[0].n == 30
    curve = curve_of_log(fit.log, every=4).orderBy("place").collect()
    done = [r for r in first if r.step <= 4]
    assert curve[0].step == 4 and curve[0].accuracy == rounded(sum(r.n_correct for r in done) / sum(r.n for r in done))


def test_a_full_run_learns_and_repeats(rows):
    fit = fit_stepwise(rows, 3, "id", batch=10, every=6, patience=99, shards=2, epochs=2, rate=0.05)
    assert fit.stopped is None and fit.log.count() == 2 * 30
    assert stops_of_log(fit.log, patience=99, every=6).count() == 0
    known = [r for r in rows.collect() if r.label is not None]
    right = fit.head.predict(np.array([r.vector for r in known])) == [r.label for r in known]
    assert right.mean() > 0.9
    again = fit_stepwise(rows.repartition(2), 3, "id", batch=10, every=6, patience=99, shards=2, epochs=2, rate=0.05)
    assert np.allclose(again.head.weights, fit.head.weights)


def test_one_shard_is_a_plain_loop(spark, rows):
    few = rows.where("id < 40")
    fit = fit_stepwise(few, 3, "id", batch=50, every=5, shards=1, epochs=1, rate=0.1)
    known = [r for r in few.collect() if r.label is not None]
    head = Head(Head.first_weights(5, 5, 3, 7), 5, 5, 3)
    gradient = head.loss_and_gradient(np.array([r.vector for r in known]), np.array([r.label for r in known]))[2]
    assert np.allclose(fit.head.weights, head.weights - 0.1 * gradient / (np.abs(gradient) + 1e-8), atol=1e-6)


def test_no_labelled_rows(rows):
    with pytest.raises(ValueError):
        fit_stepwise(rows.withColumn("label", F.lit(None).cast("int")), 3, "id")
