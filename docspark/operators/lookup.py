"""Joins of many words with a table of distinct ones, and dictionary lookups over token lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark.session import materialize

#: Parts into which the rows of every term are dealt, so that a very common one is not one task.
SALTS = 8
#: Tokens of a chunk, but for its last row's: a task holds them with the table's rows of their distinct terms, some 200 MB.
CHUNK_TOKENS = 1 << 21
#: Chunks that a task reads, on average: what it fetches lies beside Java's heap, so a task's share must not grow with the input.
CHUNKS_AT_ONCE = 2
#: A file's page ends with the row that fills it. Else a hundred chunks are one page, which is laid out whole beside Java's heap.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Tokens of the rows that come back from a chunk in one batch, or a single row.
BACK_TOKENS = 1 << 18


def join_terms(rows: DataFrame, table: DataFrame, term: str, spread_by: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per term; a null term meets nothing.

    The table is listed ``SALTS`` times and the rows of a term are dealt over as many parts by a hash
    of ``spread_by``. Beyond that, what is left of a hot term is split at run time like any skewed join.
    Both sides are sorted: a compressed file says too little about the size of a broadcast of its rows.
    """
    salted = table.where(F.col(term).isNotNull()).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), [term, "_salt"], how).drop("_salt")


def join_back(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` in which a null equals a null; ``found`` has one row per key."""
    other = found.withColumnsRenamed({k: f"_found_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_found_{k}"))
    return df.join(other, condition, "left").drop(*[f"_found_{k}" for k in keys])


def unique_terms(table: DataFrame) -> DataFrame:
    """``term, value`` without null terms; a term listed twice is refused."""
    table = table.select("term", "value").where(F.col("term").isNotNull())
    twice = table.groupBy("term").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"the term {twice.term!r} is listed {twice['count']} times")
    return table


class Lists:
    """The lists of a chunk: their lengths, and all their tokens in a row."""

    def __init__(self, lists: pa.ListArray):
        self.nulls = lists.is_null()
        self.lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
        self.tokens = lists.flatten()
        if pa.types.is_dictionary(self.tokens.type):
            self.tokens = self.tokens.dictionary_decode()

    def owners(self) -> np.ndarray:
        """The list that each token stands in."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def relisted(self, values: pa.Array) -> pa.ListArray:
        """Lists of the same lengths with a value per token."""
        offsets = pa.array(np.append(0, np.cumsum(self.lengths)).astype("int32"))
        return pa.ListArray.from_arrays(offsets, values, mask=self.nulls)


def places(tokens: pa.Array, terms: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Where each token stands among the distinct ``terms``, null for none."""
    return pa.compute.index_in(tokens, value_set=terms)


def packed_rows(rows: pa.Table, tokens: str, terms: Callable[[Lists], pa.Array] | None) -> tuple[bytes, pa.Array]:
    """A chunk's rows as a compressed Arrow stream in which every distinct token stands once, and the terms it asks for."""
    lists = Lists(rows[tokens].combine_chunks())
    encoded = lists.tokens.dictionary_encode()
    asked = encoded.dictionary if terms is None else terms(lists).unique()
    rows = rows.set_column(rows.schema.get_field_index(tokens), tokens, lists.relisted(encoded))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes(), asked.drop_null()


def in_chunks(df: DataFrame, tokens: str, terms: Callable[[Lists], pa.Array] | None = None, share: int = 1) -> DataFrame:
    """``_chunk, rows, terms``: consecutive rows with ``CHUNK_TOKENS`` tokens together, packed, and the distinct terms they ask for.

    With a ``share`` a chunk has that part of the tokens, for lists that ask for more than their tokens.
    """
    size = max(1, CHUNK_TOKENS // share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 33

        def chunk() -> pa.RecordBatch:
            rows, asked = packed_rows(pa.Table.from_batches(held), tokens, terms)
            lists = pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), asked)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows], pa.binary()), lists], ["_chunk", "rows", "terms"])

        for batch in batches:
            ends = np.append(0, np.cumsum(np.maximum(Lists(batch.column(tokens)).lengths, 1)))
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, int(np.searchsorted(ends, ends[at] + size - n)))
                held.append(batch.slice(at, to - at))
                n, at = n + int(ends[to] - ends[at]), to
                if n >= size:
                    yield chunk()
                    held, n, number = [], 0, number + 1
        if held:
            yield chunk()

    return df.mapInArrow(cut, "_chunk long, rows binary, terms array<string>")


def in_batches(rows: pa.Table, lengths: np.ndarray, most: int) -> pa.Table:
    """The rows in batches of up to ``most`` tokens by their ``lengths``, or one row, so that none is large where it is read."""
    ends, at, some = np.append(0, np.cumsum(np.maximum(lengths, 1))), 0, []
    whole = rows.combine_chunks()
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        some += whole.slice(at, to - at).to_batches()
        at = to
    return pa.Table.from_batches(some, rows.schema)


def meet_terms(
    df: DataFrame, tokens: str, table: DataFrame, compute: Callable[[Lists, pa.Table], pa.Array], output: str, kind: str, terms: Callable[[Lists], pa.Array] | None = None, share: int = 1
) -> DataFrame:
    """Put ``output`` in place of the list ``tokens``: what ``compute(lists, found)`` makes of it.

    The rows are cut into chunks of consecutive ones, which are written once, packed. ``found`` has the rows of
    ``table(term, ...)`` whose term occurs in the chunk, so only a chunk's distinct terms meet the table and come
    back; the packed chunk is moved once, as one row, to its terms. ``terms`` gives the asked terms of lists if they are not
    the tokens, ``share`` by how much its chunks are smaller then.
    """
    chunks = materialize(in_chunks(df, tokens, terms, share), "chunks", small=True, **PAGES)
    tasks = max(1, -(-chunks.count() // CHUNKS_AT_ONCE))
    asked = chunks.select(F.col("_chunk").alias("_of"), F.explode("terms").alias("term"))
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        asked, table = asked.repartition(tasks, "term"), table.repartition(tasks, "term")
    found = asked.join(table.hint("merge"), "term")
    kept, most = [field for field in df.schema.fields if field.name != tokens], BACK_TOKENS

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(left["rows"][0].as_buffer()).read_all()
        lists = Lists(rows[tokens].combine_chunks())
        values = compute(lists, right.combine_chunks())
        return in_batches(rows.select([field.name for field in kept]).append_column(output, values), lists.lengths, most)

    schema = StructType([*kept, *StructType.fromDDL(f"`{output}` {kind}")])
    left, right = chunks.select("_chunk", "rows").repartition(tasks, "_chunk"), found.repartition(tasks, "_of")
    return left.groupBy("_chunk").cogroup(right.groupBy("_of")).applyInArrow(chunk, schema)


def lookup_terms(df: DataFrame, keys: list[str], tokens: str, table: DataFrame, output: str, missing: object = None) -> DataFrame:
    """Replace every token by the ``value`` that ``table(term, value)`` gives it, in place.

    Tokens without an entry become ``missing``, or stay as they are when ``missing`` is None; a null
    token has no entry, a null list stays null. Lists stay whole, so rows that share one of ``keys``,
    or have a null in it, keep their own. The list itself is kept unless ``output`` takes its name.
    """
    kind = table.schema["value"].dataType.simpleString()

    def values(lists: Lists, found: pa.Table) -> pa.Array:
        value = found["value"].combine_chunks()
        got = value.take(places(lists.tokens, found["term"]))
        other = lists.tokens if missing is None else pa.scalar(missing, value.type)
        return lists.relisted(pa.compute.coalesce(got, other.cast(value.type) if missing is None else other))

    order = [*df.columns, *([] if output in df.columns else [output])]
    listed = df.withColumn("_tokens", F.col(tokens)).drop(output)
    return meet_terms(listed, "_tokens", unique_terms(table), values, output, f"array<{kind}>").select(*order)
