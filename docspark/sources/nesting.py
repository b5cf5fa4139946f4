"""Markup as rows of tags: which tag closes which, and the first nested element of each unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A comment, a CDATA section, a tag, a run of text; a ``<`` that opens none of these is text.
TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|</?[A-Za-z][^<>]*>|[^<]+|<"
NAME = r"^</?(?:[\w.-]+:)?([A-Za-z][\w.-]*)"
OPEN, CLOSE = 1, -1


def markup_tokens(df: DataFrame, content: str, *keys: str) -> DataFrame:
    """``keys, at, token, name``: the content cut into tokens; ``name`` is a tag's without prefix, in lower case."""
    found = F.regexp_extract_all(F.col(content), F.lit(TOKEN), F.lit(0))
    rows = df.select(*keys, F.posexplode(found).alias("at", "token"))
    return rows.withColumn("name", F.lower(F.nullif(F.regexp_extract("token", NAME, 1), F.lit(""))))


def tag_events(tokens: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """``keys, name, place, step``: a row per opening (1) and closing (-1) of the named tags; ``<x/>`` is both."""
    named = tokens.where(F.col("name").isin(names))
    steps = F.when(F.col("token").startswith("</"), F.array(F.lit(CLOSE))).when(F.col("token").endswith("/>"), F.array(F.lit(OPEN), F.lit(CLOSE))).otherwise(F.array(F.lit(OPEN)))
    return named.select(*keys, "name", "at", F.posexplode(steps).alias("_k", "step")).select(*keys, "name", (F.col("at") * 2 + F.col("_k")).cast("long").alias("place"), "step")


def paired(events: DataFrame, *keys: str) -> DataFrame:
    """``keys, name, start, end, depth``: every opened tag, where it is closed (null: never), how deep it lies.

    Depth is the running sum of the steps of one name, less its lowest point below zero, so that a
    closing tag without an opening one counts nothing. Among the tags of one depth openings and closings
    take turns, so a tag's end is the next row of its depth.
    """
    within = W.partitionBy(*keys, "name").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    summed = events.withColumn("_sum", F.sum("step").over(within))
    summed = summed.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(within)))
    before = W.partitionBy(*keys, "name").orderBy("place")
    summed = summed.withColumn("_stray", (F.col("step") == CLOSE) & (F.col("_low") < F.coalesce(F.lag("_low").over(before), F.lit(0))))
    level = F.col("_sum") - F.col("_low") + F.when(F.col("step") == CLOSE, 1).otherwise(0)
    levelled = summed.where("NOT _stray").withColumn("depth", level)
    end = F.lead("place").over(W.partitionBy(*keys, "name", "depth").orderBy("place"))
    return levelled.withColumn("end", end).where(F.col("step") == OPEN).select(*keys, "name", F.col("place").alias("start"), "end", "depth")


def first_nested(df: DataFrame, content: str, *keys: str, unit: str = "trans-unit", child: str = "source", having: str | None = "alt-trans") -> DataFrame:
    """``keys, place, depth, text``: of every ``unit`` element, the text of the first ``child`` within it.

    Elements follow the tree, not a pattern: units may lie in each other, equal names may nest, and an element
    that is never closed reaches to the end of the one around it, in the end of the content. ``having``
    keeps the units that hold such an element. Text is that of all descendants, CDATA unwrapped,
    comments and tags left out, entities as they stand; an empty one is an empty string, a unit without
    a ``child`` has none (null). A child that stands in another unit's child takes its text for itself.

    ``keys`` name one content; contents are independent, and a null one gives no rows. ``place`` rises with the unit's place.
    """
    tokens = markup_tokens(df, content, *keys)
    names = [unit, child] + ([having] if having else [])
    pairs = paired(tag_events(tokens, names, *keys), *keys)
    far = F.lit((1 << 62) - 1)
    pairs = pairs.withColumn("end", F.coalesce("end", far))
    after = W.partitionBy(*keys).orderBy(F.desc("start")).rowsBetween(W.unboundedPreceding, -1)
    next_child = F.min(F.when(F.col("name") == child, F.struct("start", "end"))).over(after)
    marked = pairs.withColumn("_child", next_child)
    if having:
        marked = marked.withColumn("_having", F.min(F.when(F.col("name") == having, F.col("start"))).over(after))
    units = marked.where(F.col("name") == unit)
    if having:
        units = units.where(F.col("_having") < F.col("end"))
    inside = F.col("_child.start") < F.col("end")
    units = units.select(
        *keys,
        F.col("start").alias("place"),
        "depth",
        F.when(inside, F.col("_child.start")).alias("_from"),
        F.when(inside, F.least(F.col("_child.end"), F.col("end"))).alias("_to"),
    )
    chosen = units.where("_from IS NOT NULL").groupBy(*keys, "_from").agg(F.max("_to").alias("_to"))
    words = F.when(F.col("token").startswith("<![CDATA["), F.regexp_extract("token", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)).when(F.col("name").isNull() & ~F.col("token").startswith("<!--"), F.col("token"))
    texts = tokens.select(*keys, (F.col("at") * 2).cast("long").alias("place"), words.alias("word")).where("word IS NOT NULL")
    line = texts.select(*keys, "place", "word", F.lit(None).cast("long").alias("_to")).unionByName(
        chosen.select(*keys, F.col("_from").alias("place"), F.lit(None).cast("string").alias("word"), "_to")
    )
    sofar = W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumn("_from", F.last(F.when(F.col("_to").isNotNull(), F.col("place")), ignorenulls=True).over(sofar))
    line = line.withColumn("_until", F.last("_to", ignorenulls=True).over(sofar))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), "")
    found = line.where("word IS NOT NULL AND place < _until").groupBy(*keys, "_from").agg(joined.alias("text"))
    both = units.join(found, [*keys, "_from"], "left")
    return both.select(*keys, "place", "depth", F.when(F.col("_from").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"))
