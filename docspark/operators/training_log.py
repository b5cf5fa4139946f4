"""Minibatches, running training metrics and early stopping over log tables.

Running values are computed in two levels so that no key, however long its log, is gathered in one
task: rows are ranged by key and order into partitions of like size, the totals of a key in each
partition (a partial aggregate) are accumulated, and each partition finishes its own rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.lookup import join_back
from docspark.operators.numbering import number_rows
from docspark.session import materialize

# Steps between reports, reports without a new peak before a run stops.
REPORT_EVERY = 100
PATIENCE = 20


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add running sums and maxima per key, up to and including each row.

    ``order`` is unique within a key; gaps do not matter. A null key is a key, a null order comes
    before all others, and rows that tie in it may come in any order among themselves. The ranged
    rows are written once, so totals and rows agree when a task runs again.
    """
    named = [(name, column, F.sum) for name, column in (sums or {}).items()]
    named += [(name, column, F.max) for name, column in (maxima or {}).items()]
    keys = list(keys)
    n = partitions or max(1, df.rdd.getNumPartitions())
    rows = df.withColumns({f"_v_{name}": column for name, column, _ in named})
    rows = materialize(rows.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy(*keys, "_part")
        .agg(*[fold(f"_v_{name}").alias(f"_t_{name}") for name, _, fold in named])
        .select(*keys, "_part", *[fold(f"_t_{name}").over(before).alias(f"_b_{name}") for name, _, fold in named])
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_back(rows, parts, [*keys, "_part"])
    results = {}
    for name, _, fold in named:
        here = fold(f"_v_{name}").over(inside)
        carried = F.col(f"_b_{name}")
        results[name] = F.greatest(here, carried) if fold is F.max else here + F.coalesce(carried, F.lit(0))
    return joined.withColumns(results).select(*df.columns, *results)


def file_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``batch_id`` in the order of a unique column, as validation reads its rows; null comes first."""
    rows = number_rows(df, [F.col(order)], "_place")
    return rows.withColumn("batch_id", F.expr(f"_place div {int(size)}")).drop("_place")


def shuffled_batches(df: DataFrame, key: str, size: int, seed: str = "") -> DataFrame:
    """Add ``batch_id`` in the order of the md5 of a unique key: a repeatable shuffle.

    A null key is hashed as the empty text. Rows are ranged by the hash, so partitions are alike.
    """
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = number_rows(df.withColumn("_hash", hashed), [F.col("_hash"), F.col(key)], "_place")
    return rows.withColumn("batch_id", F.expr(f"_place div {int(size)}")).select(*df.columns, "batch_id")


def number_steps(
    df: DataFrame, keys: Sequence[str], order: str, loss: str, n_correct: str, n: str, partitions: int | None = None
) -> DataFrame:
    """Add the 0-based ``step`` and the running ``loss_sum, correct_sum, n_sum`` since epoch start."""
    rows = running(
        df,
        keys,
        order,
        sums={"_steps": F.lit(1), "loss_sum": F.col(loss), "correct_sum": F.col(n_correct), "n_sum": F.col(n)},
        partitions=partitions,
    )
    return rows.withColumn("step", F.col("_steps") - 1).drop("_steps")


def training_curve(steps: DataFrame, keys: Sequence[str], order: str, every: int = REPORT_EVERY) -> DataFrame:
    """Running mean loss and accuracy at every ``every``-th step but step 0, rounded to 4 decimals.

    Steps count from 0, so the report at step 100 averages 101 batches. The accuracy of no
    examples is null.
    """
    return steps.filter((F.col("step") % every == 0) & (F.col("step") != 0)).select(
        *keys,
        order,
        "step",
        F.round(F.col("loss_sum") / (F.col("step") + 1), 4).alias("loss"),
        F.round(F.try_divide(F.col("correct_sum"), F.col("n_sum")), 4).alias("accuracy"),
    )


def epoch_summary(log: DataFrame, keys: Sequence[str], loss: str, n_correct: str, n: str) -> DataFrame:
    """``keys, n_batches, loss, accuracy``: mean batch loss and share of right examples, to 4 decimals."""
    share = F.try_divide(F.sum(n_correct), F.sum(n))
    return log.groupBy(*keys).agg(
        F.count("*").alias("n_batches"), F.round(F.avg(loss), 4).alias("loss"), F.round(share, 4).alias("accuracy")
    )


def early_stop(curve: DataFrame, run: str, order: str, patience: int = PATIENCE, partitions: int | None = None) -> DataFrame:
    """The report at which each run stops: ``patience`` reports in a row without a new peak.

    The peak starts at 0, only a strictly greater accuracy raises it (a null one does not), and its
    state spans epochs, so ``order`` must run through them. Between two peaks the running maximum is
    constant, hence one group by (run, peak) gives where each stretch starts and how long it is. Runs
    that never stop have no row. The numbered reports are written once and read twice.
    """
    reports = running(
        curve, [run], order, sums={"_report": F.lit(1)}, maxima={"_max": F.col("accuracy")}, partitions=partitions
    ).withColumn("peak", F.greatest("_max", F.lit(0.0)))
    reports = materialize(reports, "reports")
    lead = F.when(F.col("peak") > 0, 1).otherwise(0)
    stops = (
        reports.groupBy(run, "peak")
        .agg(F.min("_report").alias("_from"), F.count("*").alias("_length"))
        .filter(F.col("_length") - lead >= patience)
        .groupBy(run)
        .agg(F.min(F.col("_from") + lead + (patience - 1)).alias("_stop"))
    )
    return join_back(reports, stops, [run]).where("_report = _stop").drop("_max", "_report", "_stop")
