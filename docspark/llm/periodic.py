"""Periodic runs of words: segments split at words too rare to recur, then scanned lag by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import FACTORS, mixed, powers, slices, string_hashes, text_bytes, whole_text

#: Least words of a run, and least times that its period fits into it.
LEAST, TIMES = 12, 2
#: Bytes of text whose words are handled together, and places that are compared together.
PART, PLACES = 1 << 20, 1 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def surviving_segments(word: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``word`` in which every word occurs at least ``times`` times.

    Any word of a run with ``times`` periods occurs as often within it, so a word rarer than that in its
    segment is in no run and splits it. The pieces are counted anew, until none of them changes;
    pieces shorter than ``least`` go, and pieces that need no split are not looked at again.
    """
    starts, ends = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    at, segment = np.arange(len(word)), owner.astype("int64")
    words = int(word.max()) + 1 if len(word) else 1
    while len(at):
        long = np.bincount(segment)[segment] >= least
        at, segment = at[long], segment[long]
        if not len(at):
            break
        _, which, count = np.unique(segment * words + word[at], return_inverse=True, return_counts=True)
        often = count[which] >= times
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[~often]] = True
        stable = ~split[segment]
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        last = np.append(first[1:], len(segment)) - 1
        whole = stable[first]
        starts.append(at[first[whole]])
        ends.append(at[last[whole]] + 1)
        go = often & ~stable
        at, segment = at[go], segment[go]
        segment = np.cumsum((np.diff(at, prepend=-2) > 1) | (np.diff(segment, prepend=-1) != 0)) - 1
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts)
    return starts[order], ends[order]


def stretch(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from ``a`` agree with those from ``b`` (or before both), up to ``most``, by hashes."""
    found = np.zeros(len(a), "int64")
    step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
    while step:
        to = found + step
        able = np.flatnonzero(to <= most)
        one, two, n = a[able], b[able], to[able]
        if ahead:
            same = string_hashes(sums, one, one + n) == string_hashes(sums, two, two + n)
        else:
            same = string_hashes(sums, one - n, one) == string_hashes(sums, two - n, two)
        found[able[same]] += step
        step >>= 1
    return found


def lag_scan(word: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows ``start, end, period`` of all runs that lie in the given segments.

    A run of period ``q`` is a stretch of ``s`` or more places that agree with the place ``q`` further on,
    with ``s`` the greater of ``(times - 1) * q`` and ``least - q``, so it covers a multiple of ``s``. Only these
    multiples are compared, about ``n log n`` in a segment of ``n`` words for all lags together; where
    they agree, the stretch is followed both ways by halving on hashes of the words.
    """
    none = np.zeros((0, 3), "int64")
    size = ends - starts
    lags = size // times
    if not lags.sum():
        return none
    with np.errstate(over="ignore"):
        back = powers(pow(FACTORS[0], -1, 1 << 64), len(word))
        sums = np.zeros(len(word) + 1, "uint64")
        np.cumsum(mixed(word.astype("uint64") + np.uint64(1)) * back[: len(word)], out=sums[1:])
    segment = np.repeat(np.arange(len(starts)), lags)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    step = np.maximum((times - 1) * lag, least - lag)
    places = np.maximum(-(-(size[segment] - lag) // step), 0)
    before = np.cumsum(places)
    found, row = [none], 0
    while row < len(lag):
        done = before[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(before, done + PLACES, "right")))
        n = places[row:to]
        which = np.repeat(np.arange(row, to), n)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * step[which]
        a = starts[segment[which]] + place
        same = word[a] == word[a + lag[which]]
        a, which = a[same], which[same]
        row = to
        if not len(a):
            continue
        q, low, high = lag[which], starts[segment[which]], ends[segment[which]]
        right = stretch(sums, a, a + q, high - q - a, True)
        left = stretch(sums, a, a + q, a - low, False)
        start, end = a - left, a + right + q
        long = end - start >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # one stretch with several lags: the least is its period
    return runs[first]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Maximal stretches of words that repeat with some period, and the text with one period of each.

    A run is a stretch of at least ``least`` words and ``times`` times its smallest period, that no
    neighbouring word extends. Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, compared as they
    stand. Documents are independent rows of the scan, nothing is shuffled; a task holds about a
    megabyte of texts, or one longer text, at a time.

    Returns ``doc_id, n_words, runs, collapsed`` per input row: ``runs`` are structs ``start, length, period`` in
    words from 0, by start, then period; ``collapsed`` has the words, joined by one space, but those that
    any run contains after its first period. A null text is empty: no words, no runs, an empty
    text. Repeated rows and null ids give a row each; an empty table gives none; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, PART):
                data, edges = text_bytes(part.column(1))
                lists = [data[a:b].tobytes().split() for a, b in zip(edges[:-1], edges[1:])]  # bytes split at just these six
                number: dict[bytes, int] = {}
                word = np.array([number.setdefault(w, len(number)) for words in lists for w in words], "int64")
                counts = np.array([len(words) for words in lists], "int64")
                base = np.cumsum(counts) - counts
                runs = lag_scan(word, *surviving_segments(word, np.repeat(np.arange(len(lists)), counts), least, times), least, times)
                runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                owner = np.searchsorted(base + counts, runs[:, 0], "right")
                cover = np.zeros(len(word) + 1, "int64")
                np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
                np.add.at(cover, runs[:, 1], -1)
                kept = np.cumsum(cover)[:-1] == 0
                having = set(owner.tolist())
                texts = [
                    b" ".join([w for w, k in zip(words, kept[base[i] : base[i] + len(words)].tolist()) if k] if i in having else words)
                    for i, words in enumerate(lists)
                ]
                columns = [pa.array(x) for x in (runs[:, 0] - base[owner], runs[:, 1] - runs[:, 0], runs[:, 2])]
                offsets = np.searchsorted(owner, np.arange(len(lists) + 1)).astype("int32")
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(RUN)))
                arrays = [part.column(0), pa.array(counts), listed, pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_report(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: first, then shortest period) and digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best_of = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return best_of.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: every tenth document, by the CRC of its id, with a tail that repeats its own words.

    With ``h`` the unsigned CRC-32 of the decimal id, ``g = h div 10`` and ``n`` words, words from ``a = g % n`` on
    repeat those from ``a`` with a period of ``1 + (n - a) div (3 + g % 8)``. Null ids have no CRC and stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.select("*", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words"))
    rows = rows.select("*", F.size("words").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", F.expr("int(1 + (n - a) div (3 + g % 8))").alias("p"))
    source = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))
