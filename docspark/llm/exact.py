"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import WHITE, whole_text
from docspark.session import materialize

#: Runs that one round merges into one: three binomial exchanges at a time.
FAN_BITS = 3
KEY = ("digest", "proof")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: run (the partition that read it), row number, digest, proof and length."""
    bare = F.regexp_replace("text", WHITE, "")
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
        .select("doc_id", F.char_length("text").cast("long").alias("n_chars"), bare.alias("bare"))
        .select(
            "doc_id",
            "n_chars",
            F.unhex(F.sha2("bare", 256)).alias("digest"),
            F.struct(F.xxhash64("bare").alias("hash"), F.octet_length("bare").alias("bytes")).alias("proof"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def preference() -> Column:
    """Greater is better: more code points, an id before none, the smaller id, the earlier row."""
    return F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))


def merged(runs: DataFrame) -> DataFrame:
    """Merge the sorted runs that now bear one run number: the best row and the number of rows per digest."""
    return runs.groupBy("run", *KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def coarser(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run", F.shiftright("run", FAN_BITS))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that are equal without white space: which row of each group stays.

    Up the tree, every partition's run of digests is merged with its neighbours', ``2 ** FAN_BITS``
    at a time, keeping per digest the best identifier so far and a count; rows are one digest only
    if SHA-256, a second hash and the length in bytes agree. Down the tree the winners go back the
    same way, so a digest that a third of all rows share meets at most ``2 ** FAN_BITS`` rows of
    one key at a level, and at the leaves the rows of one partition.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, a row per input row. A null text is
    empty; empty texts are one group. A null id stays only if no row of its group has one, and
    ``keep_id`` is null then. Of repeated rows one is kept. An empty table gives no rows; other
    columns are not read.
    """
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    last = rows.agg(F.max("run")).first()[0] or 0
    first = rows.select("run", *KEY, preference().alias("best"), F.lit(1).cast("long").alias("n"))
    levels = [materialize(merged(first), "digest-runs")]
    while last:
        levels.append(materialize(merged(coarser(levels[-1])), "digest-runs"))
        last >>= FAN_BITS
    winners = levels.pop()
    for level in reversed(levels):
        down = level.select("run", F.shiftright("run", FAN_BITS).alias("to"), *KEY)
        winners = down.join(winners.withColumnRenamed("run", "to"), ["to", *KEY]).select("run", *KEY, "best", "n")
    return rows.join(winners, ["run", *KEY]).select(
        "doc_id",
        F.bitwise_not(F.col("best.id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.bitwise_not(F.col("best.row")) == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
