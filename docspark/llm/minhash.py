"""Near-duplicate documents by BagMinHash signatures of word shingles, banding and exact overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import KEY, STEP, keyed, matched, mixed, shingles, slices, text_bytes, whole_text
from docspark.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Components of a signature and components in a band: at 0.8, (1 - 0.8 ** 4) ** 32 = 5e-8 of all pairs share no band.
SIZE, ROWS = 128, 4
BANDS = SIZE // ROWS
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
UNIT = 2.0**-53


def bags(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of shingles of each text: distinct shingles, the text each is in, how often."""
    hashes, owner = shingles(data, starts, SHINGLE)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash: ``n`` rows of ``size`` values; two rows agree in a place with the weighted Jaccard similarity.

    Every element has Poisson processes over the weight levels (0, 1], (1, 2], (2, 4], (4, 8] and so
    on, whose points do not depend on the text: a time, a weight within the level and a place in the
    signature. A text sees the points up to its weight of the element, and keeps the earliest time per
    place. A process ends once its time is behind the latest entry of the text's signature, so all but
    the first few points of a long text's elements are never made.
    """
    signature = np.full(n * size, np.inf)
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype("int64")
    which = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mixed(element[which] + (level.astype("uint64") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    text, most = owner[which], weight[which].astype("float64")
    time, made, points = np.zeros(len(which)), np.zeros(len(which), "uint64"), 1
    while len(text):
        counter = made[:, None] + np.arange(1, points + 1, dtype="uint64")[None, :]
        one = mixed(seed[:, None] + counter * STEP)
        two = mixed(one ^ np.uint64(0x94D049BB133111EB))
        wait = -np.log(((one >> np.uint64(11)).astype("float64") + 0.5) * UNIT) / (size * width)[:, None]
        at = time[:, None] + np.cumsum(wait, axis=1)
        seen = low[:, None] + width[:, None] * ((two >> np.uint64(11)).astype("float64") * UNIT) < most[:, None]
        place = text[:, None] * size + (two % np.uint64(size)).astype("int64")
        np.minimum.at(signature, place[seen], at[seen])
        time, made = at[:, -1], made + np.uint64(points)
        some = np.unique(text)
        latest = np.zeros(n)
        latest[some] = signature.reshape(n, size)[some].max(axis=1)
        go = time < latest[text]
        seed, text, most, low, width, time, made = (x[go] for x in (seed, text, most, low, width, time, made))
        points = min(points * 2, 32)
    return signature.reshape(n, size)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, text_key``, the ``bag`` digest of its shingles (null without words), ``signature``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                n = part.num_rows
                element, owner, weight = bags(*text_bytes(part.column(2)))
                digest = np.zeros((n, 2), "uint64")
                for k in range(2):
                    np.add.at(digest[:, k], owner, mixed(mixed(element + np.uint64(k)) + weight.astype("uint64") * STEP))
                times = signatures(element, owner, weight, n)
                codes = (mixed(times.view("uint64")) & np.uint64(0xFFFF)).astype("<u2")
                some = np.bincount(owner, minlength=n) > 0
                columns = [[x.tobytes() if s else None for x, s in zip(rows, some)] for rows in (digest, codes)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "text_key", "bag", "signature"])

    return keyed(docs, id_col, text_col).mapInArrow(sign, "doc_id long, text_key long, bag binary, signature binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``bag, signature, units`` of ``bag, text, signature``: one sorted 64-bit number per shingle and copy.

    The multiset overlap of two texts is the number of units they share, so texts go no further.
    """

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                element, owner, weight = bags(*text_bytes(part.column(1)))
                copy = np.repeat(np.arange(len(element)), weight)
                number = np.arange(len(copy)) - np.repeat(np.cumsum(weight) - weight, weight)
                unit, owner = mixed(element[copy] + number.astype("uint64") * STEP), owner[copy]
                order = np.lexsort((unit, owner))
                ends = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                found = [unit[order[i:j]].tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], ["bag", "signature", "units"])

    return docs.select("bag", "text", "signature").mapInArrow(units, "bag binary, signature binary, units binary")


def similarity_of(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sorted sets of units have a Jaccard similarity of ``least``; their sizes alone may rule it out."""
    n, m = len(a) // 8, len(b) // 8
    if min(n, m) < least * max(n, m):
        return False
    common = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
    return common >= least * (n + m - common)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: every node with the smallest one of its component as ``root``.

    Alternating star rounds: neighbours of a node are hung below its smallest neighbour, until
    nothing changes; the number of rounds grows with the logarithm of the longest chain. Links are
    hung by aggregates and joins, so that no node's neighbours are gathered.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "links")
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def crowded_buckets(reps: DataFrame) -> DataFrame:
    """Band rows of the buckets that hold several bags: ``bag, band, key, leader``.

    A bucket's leader is the member that meets most others in all its buckets.
    """
    key = F.substring("signature", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    rows = reps.select("bag", "signature", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("bag", "band", key.alias("key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    crowded = materialize(rows.join(buckets, ["band", "key"]), "buckets")
    degree = crowded.groupBy("bag").agg(F.sum("members").alias("degree"))
    best = crowded.join(degree, "bag").groupBy("band", "key").agg(F.max(F.struct("degree", "bag")).alias("best"))
    return materialize(crowded.drop("members").join(best.select("band", "key", F.col("best.bag").alias("leader")), ["band", "key"]), "led")


def star_links(crowded: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified links between each bucket's leader and the rest."""
    pairs = crowded.where("bag <> leader").select("bag", "leader").distinct()
    both = pairs.join(sets, "bag").join(sets.select(F.col("bag").alias("leader"), F.col("units").alias("other")), "leader")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pa.array([similarity_of(a.as_py(), b.as_py(), least) for a, b in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), batch.column(1).filter(same)], ["a", "b"])

    return both.select("bag", "leader", "units", "other").mapInArrow(verify, "a binary, b binary")


def laid_rows(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, key, i, j, asks, bag, root``: the cells in which members that the stars left apart meet.

    Leaders have met all others, so they and buckets of two are out. Of a bucket with several components left,
    the members outside its main one ask all: askers are cut into ``BLOCK``s of their own number, and so
    are all members, so that a single stray among many costs one copy of the rest.
    """
    rest = crowded.where("bag <> leader").select("bag", "band", "key")
    known = rest.join(roots.select(F.col("node").alias("bag"), "root"), "bag", "left").withColumn("root", F.coalesce("root", "bag"))
    sizes = known.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    state = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    cut = lambda n: F.ceil(n / BLOCK).cast("int")
    state = state.select("band", "key", F.col("main.root").alias("main"), cut(F.col("members") - F.col("main.n")).alias("ask"), cut(F.col("members")).alias("give"))
    rows = known.join(state, ["band", "key"])
    own = lambda blocks: F.pmod(F.xxhash64("bag"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = rows.where("root <> main").select("*", F.lit(True).alias("asks"), own("ask").alias("i"), every("give").alias("j"))
    right = rows.select("*", F.lit(False).alias("asks"), every("ask").alias("i"), own("give").alias("j"))
    return left.unionByName(right).select("band", "key", "i", "j", "asks", "bag", "root")


def block_links(crowded: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links that the stars left out: a task holds a cell's askers and members and counts common units by an inverted list.

    A pair is looked at in its first common band only. Only verified links leave the task, one per member and component.
    """
    laid = laid_rows(crowded, roots).join(sets, "bag")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ask, give = frame[frame["asks"]], frame[~frame["asks"]].reset_index(drop=True)
        band = int(frame["band"].iloc[0])
        none = pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object)})
        if ask.empty or give.empty:
            return none
        lists = [np.frombuffer(x, "<u8") for x in give["units"]]
        total = np.array([len(x) for x in lists])
        unit, unit_owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), total)
        order = np.argsort(unit, kind="stable")
        unit, unit_owner = unit[order], unit_owner[order]
        codes = np.stack([np.frombuffer(x, "<u8") for x in give["signature"]])
        root = give["root"].to_numpy()
        links = []
        for bag, own_root, own_units, signature in zip(ask["bag"], ask["root"], ask["units"], ask["signature"]):
            mine = np.frombuffer(own_units, "<u8")
            start, end = np.searchsorted(unit, mine, "left"), np.searchsorted(unit, mine, "right")
            n = end - start
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(unit_owner[at], minlength=len(give))
            earlier = (codes[:, :band] == np.frombuffer(signature, "<u8")[:band]).any(axis=1)
            near = (common >= least * (total + len(mine) - common)) & ~earlier
            partners = {root[k]: give["bag"].iloc[k] for k in np.flatnonzero(near) if root[k] != own_root}
            links += [(bag, other) for other in partners.values()]
        return pd.DataFrame(links, columns=["a", "b"]) if links else none

    return laid.groupBy("band", "key", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Classes of documents linked by word 5-shingle multisets with a weighted Jaccard of ``similarity`` or more.

    Rows with the same multiset are one bag and go on as one. Bags that share a band of their
    signatures are compared by all their shingles: first every bucket's members with its leader, then,
    where a bucket still holds several components, all pairs across them, in blocks. Classes are the
    connected components of the verified links.

    Returns ``doc_id, text_key, class_id, class_size, kept`` per input row: ``class_id`` is the smallest
    id of the class (null only if no row has one), ``kept`` marks the row that bears it. A null text is
    empty; texts without words have no shingles and are classes of their own; shorter texts than a
    shingle are one shingle. Rows that agree in id and text are kept or not together. Empty tables
    give no rows; other columns are not read.
    """
    rows = materialize(signed(docs, id_col, text_col), "signatures")
    some = rows.where("bag IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    reps = some.groupBy("bag").agg(F.min(place).alias("first"), F.first("signature").alias("signature"))
    crowded = crowded_buckets(reps)
    wanted = reps.join(crowded.select("bag").distinct(), "bag", "left_semi").select("bag", "signature", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    found = matched(keyed(docs, id_col, text_col), wanted, KEY).dropDuplicates(["bag"])
    sets = materialize(shingle_sets(found), "shingles")
    stars = materialize(star_links(crowded, sets, similarity), "stars")
    roots = components(stars)
    blocks = materialize(block_links(crowded, roots, sets, similarity), "blocks")
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(blocks)
    roots = components(joined) if not blocks.isEmpty() else roots
    classed = rows.join(roots.withColumnRenamed("node", "bag"), "bag", "left")
    classed = materialize(classed.select("doc_id", "text_key", F.coalesce("root", "bag").alias("class")), "classed")
    classes = classed.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("class_size"))
    classes = materialize(classes, "classes")  # a join of two tables, whose large classes are split at run time
    return classed.join(classes, "class", "left").select(
        "doc_id",
        "text_key",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("class").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))).alias("kept"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, with all its columns, of each class of near duplicates."""
    kept = near_duplicates(docs, id_col, text_col, similarity).where("kept").select(*KEY).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col), F.lit(1)).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return matched(rows, kept, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
