"""What the operators of this subpackage share: row keys, hashes in numpy, files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the word and line rules, as a Java pattern.
WHITE = "[\\x20\\x09-\\x0D]"

MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_key`` and ``text`` of every row, and no other column of the input.

    The key hangs on the row's content only, so a task that runs again, over other splits even,
    gives the same one. Rows that agree in id and text are one document to every join on it.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text", F.lit(1)).alias("text_key"), "text"
    )


def matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", more: str | None = None) -> DataFrame:
    """Equi-join on ``keys`` in which a null equals a null; the result has the keys once.

    ``b``'s other columns must not bear names of ``a``'s. ``more`` is a further condition in SQL.
    """
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True) if more is None else F.expr(more)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = a.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_{k}" for k in keys])


KEY = ["doc_id", "text_key"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


# Polynomial hashes of byte strings, for whole arrays at once. With S[i] = sum of value[byte j] * F**-j
# over j < i (mod 2**64), the string from a to b has the hash (S[b] - S[a]) * F**a, wherever it stands.
FACTORS = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)
SPAN = 1 << 18
_values = [mixed(np.arange(1, 257, dtype="uint64") * np.uint64(k)) for k in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)]
_powers: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd factor modulo 2**64."""
    if len(_powers.get(factor, ())) < n:
        with np.errstate(over="ignore"):
            steps = np.full(n, factor, "uint64")
            steps[0] = 1
            _powers[factor] = np.cumprod(steps, dtype="uint64")
    return _powers[factor][:n]


def prefix_sums(data: np.ndarray, which: int = 0, values: np.ndarray | None = None) -> np.ndarray:
    """S for ``data``; its length is one more than the data's."""
    back = powers(pow(FACTORS[which], -1, 1 << 64), max(len(data), SPAN))
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum((_values[which] if values is None else values)[data] * back[: len(data)], out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the strings from ``start`` to ``end``."""
    ahead = powers(FACTORS[which], max(len(sums), SPAN))
    return mixed((sums[end] - sums[start]) * ahead[start] + (end - start).astype("uint64"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text starts, plus the end."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "int64")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "int64")
    data = np.frombuffer(column.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SPAN) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, or one text."""
    _, starts = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_white = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space, A-Z in lower case) and the text each is in."""
    blank = _white[data]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = ~blank[inner]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    last = ~blank
    last[:-1] &= blank[1:]
    last[inner - 1] = ~blank[inner - 1]
    end = np.flatnonzero(last) + 1
    hashes, cut = np.empty(len(at), "uint64"), 0
    while cut < len(at):  # spans end between words, so that no array is longer than a span or a word
        to = max(cut + 1, int(np.searchsorted(end, at[cut] + SPAN, "right")))
        base = at[cut]
        sums = prefix_sums(data[base : end[to - 1]], 0, _values[0][_lower])
        hashes[cut:to] = string_hashes(sums, at[cut:to] - base, end[cut:to] - base)
        cut = to
    return hashes, np.searchsorted(starts, at, "right") - 1


def shingles(data: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text each is in; fewer words are one shingle."""
    words, owner = word_hashes(data, starts)
    n = len(words)
    if not n:
        return words, owner
    weight = powers(FACTORS[1], size + 1)
    total = np.zeros(n, "uint64")
    inside = np.ones(n, bool)
    place = np.arange(n) - np.searchsorted(owner, owner)
    count = np.bincount(owner, minlength=len(starts))[owner]
    for j in range(size):
        there = j < count - place
        total[: n - j] += np.where(there[: n - j], words[j:] * weight[j], 0)
        inside &= there | (place == 0)
    return mixed(total[inside]), owner[inside]
