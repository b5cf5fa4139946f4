"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.session import materialize


def number_rows(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Number the rows from 0 in the given order, as a long column ``name``.

    Rows are ranged into sorted partitions, each numbers its own, and the partitions' offsets, one
    row per partition, are joined back. The ranged rows are written once, so the numbers hold when
    a task runs again. Rows that tie in ``order`` may come in any order among themselves.
    """
    n = partitions or max(1, df.rdd.getNumPartitions())
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    local = W.partitionBy("_part").orderBy(*order)
    numbered = materialize(ranged.withColumn("_local", F.row_number().over(local) - 1), "numbered")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return numbered.join(offsets, "_part").select(*df.columns, (F.col("_offset") + F.col("_local")).cast("long").alias(name))
