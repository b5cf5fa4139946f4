"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import KEY, matched, whole_text
from docspark.operators.numbering import number_rows
from docspark.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17
#: Rows that one sorted group holds on average; groups grow in number, not in size.
GROUP_ROWS = 500
WORD = "[^\\x20\\x09-\\x0D]+"


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that hangs on the given columns only."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts], F.lit(str(SEED)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sized_rows(docs: DataFrame, quality: DataFrame | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Size in words and exponential key of every row; the key is divided by the quality weight.

    ``quality`` has ``doc_id`` and ``quality`` from 0 to 1: a document weighs 1 + its mean quality,
    and 1.5 if it has none.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(whole_text(text_col), F.lit(1)).alias("text_key"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    weight = F.lit(1.5)
    if quality is not None:
        known = quality.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        rows = rows.join(known, "doc_id", "left")
        weight = F.when(F.col("quality").isNull(), 1.5).otherwise(1 + F.greatest(F.lit(0.0), F.col("quality")))
    return rows.select("doc_id", "text_key", "source", "size", (-F.ln(uniform(F.col("doc_id"))) / weight).alias("key"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Per source: size, target, whole epochs and the words left for the fractional one.

    Sources in code point order, null last, weigh ``weights`` in turn. What a source cannot take
    beyond ``most`` times its size goes to the others by weight, again and again until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(sums, [F.col("source").asc_nulls_last()], "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    sources = materialize(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("most")), "sources")
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, below = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most")
        free, taken, n = sources.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most"))), F.count(F.when(full, 1))).first()
        if n == below or not free:
            break
        below, level = n, (budget - (taken or 0.0)) / free
    target = F.least(F.col("weight") * level, F.col("most"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        sources.withColumn("target", target)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def mixed_sizes(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """How often the mix takes each document.

    Every source gives its whole epochs first. For the fraction left, its documents are drawn by
    exponential keys divided by their quality weight (Efraimidis and Spirakis), in order of the key
    up to the budget; the document at the boundary is in if at least half of it fits. The order
    comes from groups of neighbouring keys, whose sums are added up per source, so that a source
    with a third of all rows is many groups and is never sorted by one task.

    Returns ``doc_id, text_key, size, source_size, target, copies, taken`` per input row. A null text
    has size 0 and is taken with each whole epoch; a null source is a source; a null id has a key of
    its own kind; ties of the key go by id, then size; repeated rows are drawn one by one. Empty
    tables give no rows; other columns are not read.
    """
    sized = materialize(sized_rows(docs, quality, id_col, text_col, source_col), "sized")
    groups = max(16, math.ceil(sized.count() / GROUP_ROWS))
    sized = sized.withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * groups))
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sums.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    targets = source_targets(sized, weights, share, most)
    rows = matched(sized, matched(parts.drop("part_size"), targets, ["source"]), ["source", "part"])
    own = W.partitionBy("source", "part").orderBy("key", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(own) - F.col("size") / 2
    copies = F.col("epochs") + F.when((middle <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    return rows.withColumn("copies", copies).select("doc_id", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as it is taken.

    Rows that agree in id and text are one document, listed as often as they are taken together.
    """
    sizes = mixed_sizes(docs, quality, id_col, text_col, source_col, **options)
    copies = sizes.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col), F.lit(1)).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ).dropDuplicates(["doc_id", "text_key"])
    return matched(rows, copies, KEY).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
q AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)}) / coalesce(1 + quality, 1.5) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w,
        sum(source_size) OVER ()::DOUBLE * 1.5 AS budget FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source) AS i FROM n),
l AS (SELECT o.i, (any_value(o.budget) - coalesce(sum(2 * p.source_size) FILTER (p.i < o.i), 0)::DOUBLE) / sum(p.w) FILTER (p.i >= o.i) AS level FROM o, o p GROUP BY o.i),
f AS (SELECT min(o.i) AS i FROM o JOIN l USING (i) WHERE o.w * level < 2 * source_size),
t AS (SELECT source, source_size, least(w * (SELECT level FROM l JOIN f USING (i)), 2.0 * source_size)::DOUBLE AS target FROM n),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
x AS (SELECT k.doc_id, k.size, source_size, target, epochs, target - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((epochs + CASE WHEN middle <= rest AND rest > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x
"""
