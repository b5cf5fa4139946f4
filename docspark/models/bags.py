"""Bags of words as arrays, and passes over them with a table of weights per term.

A term table has one row per term, ``block, id, weights``, and is written with a folder per block of
``BLOCK`` terms. A task that reads bags loads the block it is at from the shared folder, whatever the size
of the vocabulary; the driver never sees terms or weights.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.vocabulary import bag_of_words
from docspark.session import bucketed, fresh_path

#: Terms of a block; a task holds one block's weights, 9 MB for 9 topics.
BLOCK = 1 << 17
#: Blocks of terms that a task may hold while it counts, some 150 MB.
IN_TASK = 64
#: Documents of a bucket: a pass sends one row per term it met for each bucket.
BUCKET_DOCS = 1 << 15
#: Entries of bags that are computed together.
ENTRIES = 1 << 18
#: Entries of lists of like length that are computed as one array.
TOGETHER = 1 << 14
#: Entries of whole documents that meet their terms' weights together, and blocks of weights and of sums that a task then holds.
WHOLE, HELD = 1 << 20, 8


def packed(docs: DataFrame, terms: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``key, block, ids, counts``: the counted terms of each document, by block, in buckets of ``key`` (a long).

    A vocabulary of up to ``IN_TASK`` blocks is read by the tasks, which then count their documents'
    tokens without a shuffle of words; a larger one meets the counted words by a join. The packed
    rows lie in buckets, so that every later pass joins a document's state to them without moving them.
    """
    known = terms.where(F.col("term").isNotNull())
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n = -(-max(1, docs.count()) // (BUCKET_DOCS * cores)) * cores  # whole rounds of tasks
    blocks = known.agg(F.max(F.expr(f"int(term_id div {BLOCK})"))).first()[0]
    if blocks is not None and blocks < IN_TASK:
        path = fresh_path(docs.sparkSession, "vocabulary")
        term_places(known).select("block", "id", "term").repartition("block").write.partitionBy("block").parquet(path)
        return bucketed(counted_in_tasks(docs.select(key, tokens), path, blocks + 1, BLOCK), "bags", key, n)
    long = bag_of_words(docs, known, key, tokens=tokens)
    place = F.struct(F.expr(f"int(term_id % {BLOCK})").alias("id"), F.col("tf").cast("int").alias("n"))
    rows = long.select(key, F.expr(f"int(term_id div {BLOCK})").alias("block"), place.alias("entry"))
    rows = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    rows = rows.select(key, "block", F.transform("entries", lambda e: e["id"]).alias("ids"), F.transform("entries", lambda e: e["n"]).alias("counts"))
    return bucketed(rows, "bags", key, n)


def token_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch ``key, tokens`` with up to ``ENTRIES`` tokens, or one document."""
    ends = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def counted_in_tasks(docs: DataFrame, path: str, blocks: int, size: int) -> DataFrame:
    """``packed`` rows of ``key, tokens``: a slice's distinct tokens are looked up in each block, and its entries counted by sorting."""
    key, tokens = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in token_slices(whole)):
            lengths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            encoded = batch.column(1).flatten().dictionary_encode()
            number = np.full(len(encoded.dictionary) + 1, -1, "int64")  # a null token has none
            for block in range(blocks):
                found = pa.compute.index_in(block_terms(path, block), value_set=encoded.dictionary)
                ids = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                number[found.take(pa.array(ids)).to_numpy()] = block * size + ids
            term = number[pa.compute.fill_null(encoded.indices, -1).to_numpy()]
            known = term >= 0
            pairs, counts = np.unique(np.repeat(np.arange(batch.num_rows), lengths)[known] * (blocks * size) + term[known], return_counts=True)
            place, first = np.unique(pairs // size, return_index=True)
            edges = pa.array(np.append(first, len(pairs)).astype("int32"))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype("int32"))) for x in (pairs % size, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place // blocks)), pa.array((place % blocks).astype("int32")), *lists], [key, "block", "ids", "counts"])

    some = docs.where(F.col(tokens).isNotNull())
    return some.mapInArrow(count, f"{key} long, block int, ids array<int>, counts array<int>")


def term_places(terms: DataFrame) -> DataFrame:
    """Add ``block, id``: where a numbered term stands."""
    return terms.withColumns({"block": F.expr(f"int(term_id div {BLOCK})"), "id": F.expr(f"int(term_id % {BLOCK})")})


def write_weights(rows: DataFrame, name: str) -> str:
    """Write ``block, id, weights`` with a folder per block and return the path."""
    path = fresh_path(rows.sparkSession, name)
    rows.select("block", "id", "weights").repartition("block").write.partitionBy("block").parquet(path)
    return path


def read_weights(spark, path: str) -> DataFrame:
    return spark.read.schema("id int, weights array<double>, block int").parquet(path)


def block_table(path: str, block: int, columns: list[str]) -> pa.Table:
    if path.startswith("/"):
        files, folder = pa.fs.LocalFileSystem(), path
    elif path.startswith("file:"):
        files, folder = pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        files, folder = pa.fs.FileSystem.from_uri(path)
    return pa.parquet.read_table(f"{folder}/block={block}", filesystem=files, columns=columns, partitioning=None)


@functools.lru_cache(maxsize=IN_TASK)
def block_terms(path: str, block: int) -> pa.Array:
    """The terms of a block in the order of their ids."""
    found = block_table(path, block, ["id", "term"])
    return found["term"].combine_chunks().take(pa.array(np.argsort(found["id"].to_numpy())))


@functools.lru_cache(maxsize=1)
def block_weights(path: str, block: int) -> np.ndarray:
    """The weights of a block as a matrix with a row per id; missing ids have none (zeros)."""
    found = block_table(path, block, ["id", "weights"])
    ids = found["id"].to_numpy()
    weights = found["weights"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    matrix = np.zeros((int(ids.max()) + 1, weights.shape[1]))
    matrix[ids] = weights
    return matrix


class Part:
    """Some documents' entries within one block."""

    def __init__(self, keys: np.ndarray, block: int, ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, state: np.ndarray | None):
        self.keys, self.block, self.ids, self.counts, self.starts, self.state = keys, block, ids, counts, starts, state

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per entry by document; every document has an entry."""
        return np.add.reduceat(values, self.starts[:-1])

    def by_entry(self, values: np.ndarray) -> np.ndarray:
        """A value per document for each of its entries."""
        return np.repeat(values, np.diff(self.starts))


def parts(batch: pa.RecordBatch) -> Iterator[Part]:
    """Cut a batch ``key, block, ids, counts[, state]`` where the block changes or the entries are many."""
    keys, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    offsets = batch.column(2).offsets.to_numpy().astype("int64")
    ids, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype("float64")
    offsets = offsets - offsets[0]
    state = None
    if batch.num_columns > 4:
        state = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
    row = 0
    while row < len(keys):
        same = int(np.argmax(np.append(blocks[row:] != blocks[row], True)))
        full = int(np.searchsorted(offsets, offsets[row] + ENTRIES, "right")) - 1 - row
        to = row + max(1, min(same, full))
        at = slice(offsets[row], offsets[to])
        yield Part(keys[row:to], int(blocks[row]), ids[at], counts[at], offsets[row : to + 1] - offsets[row], None if state is None else state[row:to])
        row = to


def listed(kind: str, keys, block: int, ids, values: np.ndarray, number: str) -> pa.RecordBatch:
    """Rows ``kind, key, block, id, values`` of a pass; no ``keys`` or no ``ids`` are nulls."""
    n, width = values.shape
    none = pa.nulls(n, pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * width), pa.array(values.ravel().astype(number)))
    columns = [pa.array([kind] * n), none if keys is None else pa.array(keys), pa.array(np.full(n, block, "int32")), none.cast(pa.int32()) if ids is None else pa.array(ids.astype("int32")), lists]
    return pa.RecordBatch.from_arrays(columns, ["kind", "key", "block", "id", "values"])


def sweep(rows: DataFrame, path: str, step: Callable, finish: Callable | None = None, prepare: Callable | None = None, blocks: int = 1, single: bool = False) -> DataFrame:
    """One pass over ``key, block, ids, counts[, state]`` with the weights at ``path``.

    ``step(part, weights, sums)`` returns values per document, or None, and may add to ``sums``, a matrix with
    a row per term of the block and what else it puts there. Returns ``kind, key, block, id, values``: ``doc`` rows
    from ``step``, ``term`` rows for the sums of a task's terms after ``finish(weights, sums)``, and ``all`` rows for
    ``sums["all"]``. ``prepare`` turns a block's weights into what ``step`` reads. ``single`` sends values in four
    bytes, for passes that need no more.
    """
    prepare = prepare or (lambda weights: weights)
    number, name = ("float32", "float") if single else ("float64", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, sums = None, None, {}

        def out(kind: str, keys, ids, values) -> pa.RecordBatch:
            return listed(kind, keys, -1 if block is None else block, ids, values, number)

        def flush() -> Iterator[pa.RecordBatch]:
            if "terms" in sums:
                total = finish(weights, sums["terms"]) if finish else sums["terms"]
                ids = np.flatnonzero(sums["seen"])
                yield out("term", None, ids, total[ids])
            if "all" in sums:
                yield out("all", None, None, sums["all"][None, :])

        for batch in batches:
            for part in parts(batch):
                if part.block != block:
                    if block is not None:
                        yield from flush()
                    block, weights, sums = part.block, prepare(block_weights(path, part.block)), {}
                values = step(part, weights, sums)
                if values is not None:
                    yield out("doc", part.keys, None, values)
        if block is not None:
            yield from flush()

    ordered = rows.sortWithinPartitions("block") if blocks > 1 else rows
    return ordered.mapInArrow(run, f"kind string, key long, block int, id int, values array<{name}>")


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column is sorted, cut again where it changes, with some ``WHOLE`` entries or one document."""
    held, n = [], 0
    for batch in batches:
        ends = np.append(0, np.cumsum(np.diff(batch.column(2).offsets.to_numpy())))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + WHOLE - n, "right")) - 1)
            held.append(batch.slice(at, to - at))
            n, at = n + int(ends[to] - ends[at]), to
            if n >= WHOLE or at < batch.num_rows:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = rows.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield rows.slice(0, cut)
                held = [rows.slice(cut)]
                n = int(np.diff(held[0].column(2).offsets.to_numpy()).sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def whole_parts(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, Iterator[Part]]:
    """The numbers of a batch's terms, rising, and its documents in parts of up to ``ENTRIES``, or one; their ids are places among those numbers."""
    keys, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    lengths = np.diff(batch.column(2).offsets.to_numpy())
    number = batch.column(2).flatten().to_numpy() + np.repeat(blocks.astype("int64") * size, lengths)
    counts = batch.column(3).flatten().to_numpy().astype("float64")
    state = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
    place = np.zeros(int(number.max(initial=-1)) + 1, "int32")
    place[number] = 1
    terms = np.flatnonzero(place)
    place[terms] = np.arange(len(terms), dtype="int32")
    ids = place[number]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    starts = np.append(np.append(0, np.cumsum(lengths))[first], len(ids))

    def cut() -> Iterator[Part]:
        doc = 0
        while doc < len(first):
            to = max(doc + 1, int(np.searchsorted(starts, starts[doc] + ENTRIES, "right")) - 1)
            at = slice(starts[doc], starts[to])
            yield Part(keys[first[doc:to]], 0, ids[at], counts[at], starts[doc : to + 1] - starts[doc], state[first[doc:to]])
            doc = to

    return terms, cut()


def sweep_whole(rows: DataFrame, path: str, step: Callable, finish: Callable, prepare: Callable) -> DataFrame:
    """``sweep`` of ``key, block, ids, counts, state`` whose steps see a document's terms of all blocks together.

    The documents' rows are sorted by key and block; some ``WHOLE`` entries at a time meet the weights of their own terms,
    so a task holds no more than these, and ``HELD`` blocks of weights and of sums.
    """
    key, size = rows.columns[0], BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = {}, {}

        def block_of(block: int) -> np.ndarray:
            if block not in weights:
                if len(weights) >= HELD:
                    weights.pop(next(iter(weights)))
                weights[block] = prepare(block_weights(path, block))
            return weights[block]

        def flush() -> Iterator[pa.RecordBatch]:
            for block, (total, seen) in sums.items():
                ids = np.flatnonzero(seen)
                yield listed("term", None, block, ids, total[ids], "float64")
            sums.clear()

        for batch in whole_documents(batches):
            terms, some = whole_parts(batch, size)
            cuts = np.searchsorted(terms, np.arange(int(terms[-1]) // size + 2) * size)
            blocks = [(b, slice(*cuts[b : b + 2])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            near, found = None, {}
            for b, at in blocks:
                given = block_of(b)
                near = np.zeros((len(terms), given.shape[1])) if near is None else near
                near[at] = given[terms[at] - b * size]
            for part in some:
                yield listed("doc", part.keys, -1, None, step(part, near, found), "float64")
            if "terms" in found:
                total = finish(near, found["terms"])
                for b, at in blocks:
                    if b not in sums:
                        n = len(block_of(b))
                        sums[b] = np.zeros((n, total.shape[1])), np.zeros(n, bool)
                    sums[b][0][terms[at] - b * size] += total[at]
                    sums[b][1][terms[at] - b * size] = True
            if "all" in found:
                yield listed("all", None, -1, None, found["all"][None, :], "float64")
            if len(sums) > HELD:
                yield from flush()
        yield from flush()

    return rows.sortWithinPartitions(key, "block").mapInArrow(run, "kind string, key long, block int, id int, values array<double>")


def alike(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lists of like length together: their numbers, their entries as rows of equal length, and which of these are real."""
    lengths = np.diff(starts)
    order, at = np.argsort(lengths, kind="stable"), 0
    sizes = np.maximum(lengths[order], 1)
    while at < len(order):
        most = sizes[at : at + max(1, TOGETHER // int(sizes[at]))]
        n = max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1), TOGETHER, "right")))
        some, width = order[at : at + n], int(most[n - 1])
        real = np.arange(width) < lengths[some][:, None]
        yield some, np.where(real, starts[some][:, None] + np.arange(width), 0), real
        at += n


def weighted_rows(factors: np.ndarray, rows: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row per list: the sum over its entries of a factor times the row that ``of`` names."""
    out = np.empty((len(starts) - 1, rows.shape[1]))
    for some, entry, real in alike(starts):
        out[some] = np.matmul(np.where(real, factors[entry], 0.0)[:, None, :], rows[of[entry]])[:, 0, :]
    return out


def add_wide(part: Part, factors: np.ndarray, rows: np.ndarray, sums: dict, terms: int) -> None:
    """``add_by_term`` for many columns: the entries are sorted by term, and each term's are one product."""
    if "terms" not in sums:
        sums["terms"], sums["seen"] = np.zeros((terms, rows.shape[1])), np.zeros(terms, bool)
    order = np.argsort(part.ids, kind="stable")
    ids = part.ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, "int64")
    doc = np.repeat(np.arange(len(part.keys)), np.diff(part.starts))
    sums["terms"][ids[first]] += weighted_rows(factors[order], rows, doc[order], np.append(first, len(ids)))
    sums["seen"][ids[first]] = True


def add_by_term(part: Part, factors: np.ndarray, rows: np.ndarray, sums: dict, terms: int) -> None:
    """Add each entry's factor times its document's row to its term's row of ``sums["terms"]``, and mark the terms as seen.

    Column by column, so that no table of a row per entry is made.
    """
    if "terms" not in sums:
        sums["terms"], sums["seen"] = np.zeros((terms, rows.shape[1]), order="F"), np.zeros(terms, bool)
    for j in range(rows.shape[1]):
        sums["terms"][:, j] += np.bincount(part.ids, weights=factors * part.by_entry(rows[:, j]), minlength=terms)
    sums["seen"][part.ids] = True


def summed(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """``keys, values``: sums of arrays, entry by entry, combined before the shuffle."""
    entries = [F.sum(F.get("values", F.lit(j))).alias(f"_{j}") for j in range(width)]
    return rows.groupBy(*keys).agg(*entries).select(*keys, F.array(*[f"_{j}" for j in range(width)]).alias("values"))
