"""Translation units of large files: read in splits at the closing tag, so that one file is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.sources.files import ALTERNATIVE, COMMENT_OUTSIDE_CDATA, unit_source

CLOSING = "</trans-unit>"
OPENING = r"<(?:\w+:)?trans-unit\b"
CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"
#: Rows that a task can have read before one, as the low bits of its number.
ROW_BITS = (1 << 33) - 1


def scan_pieces(spark: SparkSession, folder: str, closing: str, glob: str | None = None) -> DataFrame:
    """``path, block, pos, piece`` and folder labels: what stands before each ``closing``, and after the last one.

    The closing tag is the record separator, so the reader cuts files into splits like any text: a
    piece belongs to the split in which it starts. ``pos`` is the split's offset in the file plus the
    row's number in its task. A separator has several bytes, so a task has fewer rows than a split
    has bytes, and ``pos`` rises with the place in the file without a look at other splits.
    """
    reader = spark.read.option("lineSep", closing)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(folder)
    labels = [name for name in rows.columns if name != "value"]
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    return rows.select(
        *labels,
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_start") + number).alias("pos"),
        F.make_valid_utf8("value").alias("piece"),
    )


def carried(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null in the rows of the file before each row.

    Splits are filled on their own, and a table of one row per split has what each begins with.
    """
    known = rows.where(F.col(value).isNotNull())
    blocks = rows.select("path", "block").distinct().join(known.groupBy("path", "block").agg(F.max_by(value, "pos").alias("_last")), ["path", "block"], "left")
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_begins"))
    local = W.partitionBy("path", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(blocks, ["path", "block"]).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(local), "_begins")).drop("_begins")


def joined_pieces(pieces: DataFrame, closing: str) -> DataFrame:
    """Put pieces together whose closing tag stands in a comment; all others pass as they are.

    The last comment mark of a piece tells whether its end lies in a comment, and a piece without one
    takes over what the piece before left. If no piece ends in a comment nothing is shuffled.
    """
    mark = F.nullif(F.regexp_extract(F.regexp_replace("piece", CDATA, ""), r"(?s)^.*(<!--|-->)", 1), F.lit(""))
    marked = pieces.withColumn("_mark", mark)
    if marked.where("_mark = '<!--'").isEmpty():
        return pieces
    state = carried(marked, "_mark", "_before")
    inside = F.coalesce(F.col("_before") == "<!--", F.lit(False))
    state = state.select("*", (~inside).alias("_starts"), F.coalesce(F.col("_mark"), F.col("_before"), F.lit("-->")).alias("_after"))
    whole = state.where("_starts AND _after <> '<!--'").select(*pieces.columns)
    parts = state.where("NOT _starts OR _after = '<!--'").withColumn("_first", F.when(F.col("_starts"), F.col("pos")))
    parts = carried(parts, "_first", "_from").withColumn("_place", F.col("pos")).withColumn("pos", F.coalesce("_first", "_from"))
    keys = [name for name in pieces.columns if name not in ("piece", "block")]
    texts = F.array_sort(F.collect_list(F.struct("_place", "piece")))
    long = parts.groupBy(*keys).agg(F.min("block").alias("block"), texts.alias("_texts"))
    long = long.withColumn("piece", F.array_join(F.transform("_texts", lambda t: t["piece"]), closing))
    return whole.unionByName(long.select(*pieces.columns))


def scan_units(spark: SparkSession, folder: str, closing: str = CLOSING, opening: str = OPENING, glob: str | None = None) -> DataFrame:
    """``path, pos, unit`` and folder labels: every unit of every file below ``folder``, however large.

    A unit reaches from the first opening tag after the one before it to its closing tag, comments
    outside CDATA sections removed. ``closing`` is taken literally, so files with a prefix need
    ``</x:trans-unit>``; files are UTF-8, and bad bytes never fail the job. ``pos`` rises with the place in
    the file, with gaps. An opening tag that is never closed reaches to the end of its file, as a
    lenient parser has it. Empty files give no rows.
    """
    pieces = joined_pieces(scan_pieces(spark, folder, closing, glob), closing)
    bare = F.regexp_replace("piece", COMMENT_OUTSIDE_CDATA, "$1")
    unit = F.regexp_extract(bare, f"(?s){opening}.*", 0)
    kept = [name for name in pieces.columns if name not in ("piece", "block")]
    found = pieces.withColumn("piece", unit).select(*kept, F.inline(F.filter(F.array(F.struct(F.col("piece").alias("unit"))), lambda u: u["unit"] != "")))
    return found.withColumn("unit", F.concat("unit", F.lit(closing)))


def scan_trans_units(spark: SparkSession, folder: str, closing: str = CLOSING, glob: str | None = None) -> DataFrame:
    """``path, pos, unit, segment`` and folder labels: source texts of the units that hold an ``alt-trans``."""
    units = scan_units(spark, folder, closing, glob=glob).where(F.col("unit").rlike(ALTERNATIVE))
    return units.withColumn("segment", unit_source(F.col("unit")))
