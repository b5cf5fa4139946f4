"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import KEY, keyed, matched

WIDTH = 3


def window_hashes(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per window of ``width`` consecutive lines: document key, line number, 128 bits of hash."""
    lines = F.split("text", "\n", -1)
    hashed = rows.select(
        "doc_id",
        "text_key",
        F.transform(lines, lambda x: F.xxhash64(x)).alias("a"),
        F.transform(lines, lambda x: F.xxhash64(F.lit(7), x)).alias("b"),
    ).where(F.size("a") >= width)
    window = F.transform(
        F.sequence(F.lit(0), F.size("a") - width),
        lambda i: F.struct(
            i.alias("line"),
            F.xxhash64(*[F.get("a", i + j) for j in range(width)]).alias("h1"),
            F.xxhash64(*[F.get("b", i + j) for j in reversed(range(width))]).alias("h2"),
        ),
    )
    return hashed.select("doc_id", "text_key", F.inline(window))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Remove every repeated window of ``width`` lines but its first occurrence in the corpus.

    Occurrences are ordered by document id (null last), then content, then line. Removed windows
    may overlap; the lines that any of them covers go, judged on the input. The hashes are counted
    with map-side combining, so a very common window costs one row per task; only occurrences of
    repeated windows go on, and the join that finds them has rows of a few dozen bytes, whose hot
    keys the engine splits at run time. A document's own lines meet again in one row.

    Returns ``doc_id, text, n_lines, n_removed`` per input row. A null text is empty (one empty
    line); documents of fewer lines than ``width`` stay as they are; rows that agree in id and text
    are one document and get one result. An empty table gives no rows; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    windows = window_hashes(rows, width)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy(*KEY).agg(F.collect_set("line").alias("starts"))
    found = matched(rows, covered, KEY, "left")
    removed = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    return (
        found.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), removed.alias("removed"))
        .select(
            "doc_id",
            F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("removed_size"),
        )
        .select("doc_id", "text", "n_lines", F.greatest("removed_size", F.lit(0)).alias("n_removed"))
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d),
w AS (SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS t FROM x WHERE i + 3 <= len(l)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 3) AS s(j)),
k AS (
  SELECT x.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
    coalesce(string_agg(CASE WHEN c.i IS NULL THEN l[x.i + 1] END, chr(10) ORDER BY x.i), '') AS kept
  FROM x LEFT JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
