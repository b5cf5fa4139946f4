"""Repeated byte strings by prefix-free parsing: phrases between rolling-hash triggers, sorted suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import KEY, keyed, matched, prefix_sums, slices, string_hashes, text_bytes
from docspark.session import materialize

#: Bytes of a string that counts as repeated, and of the grams that the rolling hash sees.
LENGTH, GRAM = 200, 16
#: Greatest number of neighbouring string starts that one phrase holds.
PHRASE = 100
#: One row in so many is parsed beforehand to find crowded cores, those with so many phrases there.
SAMPLE, CROWD = 64, 50
#: Bytes that are parsed at a time; longer texts are parsed in overlapping pieces.
PIECE = 1 << 18
#: Bytes of phrases whose suffixes a task ranks together, some 60 bytes of memory for each, but for those of a single core.
GROUP = 1 << 20
#: Bytes of text whose phrases one shard of the dictionary gets, whatever the splits of the input.
SHARD = 1 << 25

_PHRASE = np.dtype([("core", "<u8"), ("whole", "<u8"), ("row", "<u4"), ("start", "<u4"), ("starts", "<u2"), ("many", "u1")])
_PLACE = np.dtype([("row", "<u4"), ("start", "<u4"), ("starts", "<u2")])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    least, have = values, 1
    while have * 2 <= width:
        least, have = np.minimum(least[: len(least) - have], least[have:]), have * 2
    return np.minimum(least[: len(values) - width + 1], least[width - have :]) if width > have else least


def parse(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM, phrase: int = PHRASE) -> dict[str, np.ndarray]:
    """Phrases of the texts of at least ``length`` bytes.

    The trigger of a string is its gram with the least rolling hash, the leftmost in a tie, so equal
    strings have equal triggers wherever they stand. A phrase is a run of string starts with one
    trigger, cut where the distance to it passes a multiple of ``phrase``. ``whole`` is the hash of
    all bytes that the phrase's strings cover; ``core`` that of the bytes around the trigger that any
    string with this trigger and distance has, so that equal strings lie in phrases of one core.
    """
    span = length - gram + 1
    if len(data) < length:
        return {k: np.zeros(0, "int64") for k in ("text", "start", "starts", "core", "whole")}
    sums, other = prefix_sums(data, 0), prefix_sums(data, 1)
    at = np.arange(len(data) - gram + 1)
    rolled = string_hashes(sums, at, at + gram) & np.uint64(0xFFFFFFFF00000000)
    trigger = (sliding_least(rolled | at.astype("uint64"), span) & np.uint64(0xFFFFFFFF)).astype("int64")
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(trigger)]
    at = np.arange(len(trigger))
    fits = at + length <= starts[text + 1]
    at, text, trigger = at[fits], text[fits], trigger[fits]
    away = (trigger - at) // phrase
    new = np.ones(len(at), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (away[1:] != away[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    at, text, trigger, away = at[first], text[first], trigger[first], away[first]
    near, far = away * phrase, np.minimum(away * phrase + phrase - 1, span - 1)
    return {
        "text": text,
        "start": at - starts[text],
        "starts": count,
        "core": string_hashes(sums, trigger - near, trigger - far + length),
        "whole": string_hashes(other, at, at + count + length - 1, 1),
    }


def parsed(batch: pa.RecordBatch, column: int, length: int, phrase: int) -> Iterator[dict[str, np.ndarray]]:
    """Phrases of a batch, part by part; ``text`` is the row in the batch, long texts come in pieces."""
    row = 0
    for part in slices(batch, column, PIECE):
        data, starts = text_bytes(part.column(column))
        if len(data) <= PIECE:
            found = parse(data, starts, length, phrase=phrase)
            yield found | {"text": found["text"] + row}
        else:
            for cut in range(0, len(data), PIECE):
                piece = data[cut : cut + PIECE + length - 1]
                found = parse(piece, np.array([0, len(piece)]), length, phrase=phrase)
                yield found | {"text": found["text"] + row, "start": found["start"] + cut}
        row += part.num_rows


def crowded_cores(docs: DataFrame, length: int, phrase: int, sample: int, crowd: int) -> np.ndarray:
    """Cores with many different phrases, by a sample of the rows; they only decide where phrases are sent.

    At least ``crowd`` phrases and one in 100,000 of the sample's are asked for, so 100,000 cores at most.
    """

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in parsed(batch, 2, length, phrase):
                yield pa.RecordBatch.from_arrays([pa.array(found[k].view("int64")) for k in ("core", "whole")], ["core", "whole"])

    some = docs.where(F.pmod(F.xxhash64("text_key", F.lit(3)), F.lit(sample)) == 0)
    counts = some.mapInArrow(cores, "core long, whole long").distinct().groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") >= crowd)
    counts = materialize(counts, "crowded", small=True)
    least = (counts.agg(F.sum("n")).first()[0] or 0) / 100_000
    return np.sort(np.array([r["core"] for r in counts.where(F.col("n") >= least).select("core").collect()], "int64").view("uint64"))


def dictionary_rows(docs: DataFrame, shards: int, length: int, phrase: int, crowded: np.ndarray) -> DataFrame:
    """Parse every text; per task, part of the corpus and shard of cores one row with its distinct phrases.

    Rows are ``shard, part, kind, data``: kind 0 holds phrases, kind 1 places of phrases that are
    repeated within one part already, kind 2 the keys of the rows that the numbers stand for. A phrase
    that stands often in one part is sent once, so a text that a third of all rows share is a few
    rows per task and not one per copy. Phrases of crowded cores, such as the ends of a passage that
    stands in very many texts, are dealt out by all their bytes instead of by their core.
    """

    def packed(out: list, part: int) -> pa.RecordBatch:
        shard, kind, base, data = zip(*out) if out else ([], [], [], [])
        columns = [pa.array(shard, pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array(kind, pa.int32()), pa.array(base, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "part", "kind", "base", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = np.stack([batch.column(0).is_null().to_numpy(False).astype("int64"), batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            yield packed([(part % shards, 2, row, keys.tobytes())], part)
            for found in parsed(batch, 2, length, phrase):
                out = []
                rows = np.zeros(len(found["start"]), _PHRASE)
                for name in ("core", "whole", "start", "starts"):
                    rows[name] = found[name]
                rows["row"] = found["text"] + row
                order = np.lexsort((rows["whole"], rows["core"]))
                rows = rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows["core"][1:] != rows["core"][:-1]) | (rows["whole"][1:] != rows["whole"][:-1])
                at = np.flatnonzero(new)
                many = np.diff(np.append(at, len(rows))) > 1
                settled = np.repeat(many, np.diff(np.append(at, len(rows))))
                if settled.any():
                    places = np.zeros(int(settled.sum()), _PLACE)
                    for name in _PLACE.names:
                        places[name] = rows[name][settled]
                    out.append((part % shards, 1, row, places.tobytes()))
                rows = rows[at]
                apart = np.isin(rows["core"], crowded)
                rows["many"] = many + 2 * apart
                shard = (np.where(apart, rows["whole"], rows["core"]) % np.uint64(shards)).astype("int64")
                order = np.argsort(shard, kind="stable")
                rows, shard = rows[order], shard[order]
                cuts = np.flatnonzero(np.diff(shard)) + 1
                out += [(int(s[0]), 0, row, r.tobytes()) for s, r in zip(np.split(shard, cuts), np.split(rows, cuts)) if len(r)]
                yield packed(out, part)
            row += batch.num_rows

    return docs.mapInArrow(send, "shard int, part int, kind int, base long, data binary")


def settled_phrases(rows: DataFrame, shards: int) -> DataFrame:
    """Merge the dictionaries of each shard: places of phrases and what is known of them.

    Returns ``kind, part, row, start, starts, core, asks, apart, doc_id, text_key``: kind 1 for
    phrases that occur twice or more, all of whose strings are repeated; kind 0 for phrases that
    share only their core with another, or have a crowded core, and must be compared (one place of a
    repeated phrase comes along to be compared with and does not ask); kind 2 for the keys of the rows.
    """
    schema = "kind int, part int, row long, start long, starts int, core long, asks boolean, apart boolean, doc_id long, text_key long"

    def table(kind: int, part, row, start=0, starts=0, core=0, asks=False, apart=False, doc_id=None, text_key=0) -> pa.RecordBatch:
        n = len(row)
        full = lambda x, t: pa.array(np.full(n, x, t) if np.isscalar(x) else np.asarray(x).astype(t))
        ids = pa.nulls(n, pa.int64()) if doc_id is None else doc_id
        return pa.RecordBatch.from_arrays(
            [full(kind, "int32"), full(part, "int32"), full(row, "int64"), full(start, "int64"), full(starts, "int32"), full(core, "int64"), full(asks, "bool"), full(apart, "bool"), ids, full(text_key, "int64")],
            ["kind", "part", "row", "start", "starts", "core", "asks", "apart", "doc_id", "text_key"],
        )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, parts = [], []
        for batch in batches:
            for _, part, kind, base, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    phrases.append(np.frombuffer(data, _PHRASE))
                    parts.append(np.full(len(phrases[-1]), part, "int32"))
                elif kind == 1:
                    p = np.frombuffer(data, _PLACE)
                    yield table(1, part, p["row"], p["start"], p["starts"])
                else:
                    keys = np.frombuffer(data, "int64").reshape(-1, 3)
                    yield table(2, part, base + np.arange(len(keys)), doc_id=pa.array(keys[:, 1], mask=keys[:, 0] == 1), text_key=keys[:, 2])
        if not phrases:
            return
        rows, part = np.concatenate(phrases), np.concatenate(parts)
        order = np.lexsort((rows["whole"], rows["core"]))
        rows, part = rows[order], part[order]
        new_core = np.append(True, rows["core"][1:] != rows["core"][:-1])
        new = new_core | np.append(True, rows["whole"][1:] != rows["whole"][:-1])
        phrase, core = np.cumsum(new) - 1, np.cumsum(new_core) - 1
        local, apart = rows["many"] & 1, rows["many"] > 1
        twice = np.bincount(phrase, weights=1 + local)[phrase] > 1
        yes = twice & (local == 0)
        yield table(1, part[yes], rows["row"][yes], rows["start"][yes], rows["starts"][yes])
        shared = (np.bincount(core, weights=new)[core] > 1) & (np.bincount(core, weights=~twice)[core] > 0)
        ask = new & (shared | apart)
        yield table(0, part[ask], rows["row"][ask], rows["start"][ask], rows["starts"][ask], rows["core"][ask].view("int64"), ~twice[ask], apart[ask])

    return rows.repartition(shards, "shard").mapInArrow(settle, schema)


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The suffix array's ranks to a depth of ``length`` bytes: equal numbers for equal strings, in their order.

    Prefix doubling: the ranks of all strings of ``k`` bytes, in pairs ``k`` apart, are sorted to
    ranks of ``2k`` bytes; the last round takes overlapping halves.
    """
    have = min(8, length)
    n = len(data) - have + 1
    rank = np.zeros(n, "uint64")
    for j in range(have):
        rank = (rank << np.uint64(8)) | data[j : j + n]
    rank = np.unique(rank, return_inverse=True)[1]
    while have < length:
        step = min(have, length - have)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, have = np.unique(pairs, return_inverse=True)[1], have + step
    return rank


def core_groups(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.Table]:
    """Rows sorted by ``core`` in groups of whole cores, with up to ``most`` bytes of phrases or one core."""
    held = []
    waiting = 0

    def cut(last: bool) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        core = table.column("core").to_numpy()
        first = np.append(np.flatnonzero(np.append(True, core[1:] != core[:-1])), len(core))
        ends = np.append(0, np.cumsum(table.column("starts").to_numpy().astype("int64") + length - 1))[first]
        at, stop = 0, len(first) - (1 if last else 2)  # the last core may go on in the next batch
        while at < stop:
            to = min(stop, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
            if to == stop and not last and at:
                break
            yield table.slice(first[at], first[to] - first[at])
            at = to
        held[:] = table.slice(first[at]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            waiting += batch.num_rows * (length - 1) + int(pa.compute.sum(batch.column("starts")).as_py())
            if waiting >= most:
                yield from cut(False)
                waiting = sum(b.num_rows * (length - 1) + int(pa.compute.sum(b.column("starts")).as_py()) for b in held)
    if held:
        yield from cut(True)


def compared(texts: DataFrame, shards: int, length: int, most: int = GROUP) -> DataFrame:
    """Sort the strings of phrases that share a core; runs of starts whose string stands elsewhere too.

    ``texts`` has ``core, asks, part, row, start, starts, data``, the bytes of each phrase. A task reads
    its phrases core by core, each once, and ranks all suffixes of ``length`` bytes of some cores together.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in core_groups(batches, length, most):
            yield from repeated(table)

    def repeated(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks, part, row, start, starts = (table.column(k).to_numpy() for k in ("asks", "part", "row", "start", "starts"))
        sizes = starts + length - 1
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), "uint8")
        first = np.cumsum(sizes) - sizes
        rank = suffix_ranks(data, length)
        owner = np.repeat(np.arange(len(starts)), starts)
        inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        mine = rank[first[owner] + inner]
        again = (np.bincount(mine)[mine] > 1) & asks[owner]
        owner, inner = owner[again], inner[again]
        if not len(owner):
            return
        new = np.append(True, (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1))
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(owner)))
        o = owner[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[o]), pa.array(row[o]), pa.array(start[o] + inner[at]), pa.array(count.astype("int32"))], ["part", "row", "start", "starts"]
        )

    return texts.repartition(shards, "core").sortWithinPartitions("core").mapInArrow(compare, "part int, row long, start long, starts int")


def counted(texts: DataFrame, length: int) -> DataFrame:
    """``compared`` for phrases of crowded cores: each string by itself, counted by 128 bits of hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks, part, row, start, starts = (batch.column(k).to_numpy(False) for k in ("asks", "part", "row", "start", "starts"))
            for i, data in enumerate(batch.column("data").to_pylist()):
                bytes_, at = np.frombuffer(data, "uint8"), np.arange(starts[i])
                hashes = [string_hashes(prefix_sums(bytes_, k), at, at + length, k).view("int64") for k in range(2)]
                n = len(at)
                columns = [*hashes, np.full(n, asks[i]), np.full(n, part[i]), np.full(n, row[i]), start[i] + at]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["h1", "h2", "asks", "part", "row", "start"])

    each = texts.select("asks", "part", "row", "start", "starts", "data").mapInArrow(strings, "h1 long, h2 long, asks boolean, part int, row long, start long")
    each = materialize(each, "strings", small=True)
    again = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return each.where("asks").join(again, ["h1", "h2"], "left_semi").select("part", "row", "start", F.lit(1).alias("starts"))


def fetch(rows: DataFrame, places: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """The bytes of phrases at the given places: their texts are read again, others are not moved on."""
    place = F.struct("core", "asks", "apart", "part", "row", "start", "starts")
    wanted = places.drop("doc_id", "text_key").join(names, ["part", "row"]).groupBy(*KEY).agg(F.collect_list(place).alias("places"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            data, starts = text_bytes(batch.column(0))
            lists = batch.column(1)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            low = starts[owner] + fields["start"].to_numpy()
            high = low + fields["starts"].to_numpy() + length - 1
            pieces = pa.array([data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*fields.values(), pieces], [*fields, "data"])

    schema = "core long, asks boolean, apart boolean, part int, row long, start long, starts int, data binary"
    return materialize(matched(rows, wanted, KEY).select("text", "places").mapInArrow(take, schema), "pieces", small=True)


def cut(rows: DataFrame, runs: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """Every text without the strings whose starts ``runs`` lists."""
    per_row = runs.groupBy("part", "row").agg(F.collect_list(F.struct("start", "starts")).alias("runs"))
    per_text = per_row.join(names, ["part", "row"]).groupBy(*KEY).agg(F.first("runs").alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lists = batch.column(2)
            flat = lists.flatten()
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(False)) if len(lists) else np.zeros(0, "int64")
            start, starts = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype("int64")
            out, at = [], 0
            for text, end in zip(batch.column(1).to_pylist(), ends.tolist()):
                data = text.encode()
                kept = without(data, start[at:end], starts[at:end], length) if end > at else (data, 0, 0)
                out.append((len(data), kept[1], kept[2], kept[0]))
                at = end
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = matched(rows, per_text, KEY, "left").select("doc_id", "text", "runs")
    return found.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without(data: bytes, start: np.ndarray, starts: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """The bytes that no string covers; how many go, and in how many runs."""
    order = np.argsort(start)
    low, high = start[order], np.maximum.accumulate((start + starts + length - 1)[order])
    new = np.append(True, low[1:] > high[:-1])
    low, high = low[new], high[np.append(new[1:], True)]
    kept, at = [], 0
    for a, b in zip(low.tolist(), high.tolist()):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), int((high - low).sum()), len(low)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, phrase: int = PHRASE, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    1. Every text is parsed into phrases by rolling-hash triggers. 2. The phrases make a dictionary,
    sharded by the hash of the bytes around their trigger; a phrase that stands twice is repeated
    as a whole, which settles copies of any size without looking at their bytes again, and a phrase
    that shares its core with no other has no repeated string. 3. Only the rest, where a copy begins
    or ends, is fetched and its suffixes are sorted, some cores at a time; equal neighbours in corpus
    order are repeated. Hashes have 128 bits where they settle a phrase; suffixes are compared exactly.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) per input row. A null text is empty;
    texts shorter than ``length`` stay as they are; rows that agree in id and text are separate
    occurrences of their strings, so all of their long strings go. Strings end where their text ends. Empty
    tables give no rows; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, docs.rdd.getNumPartitions(), -(-size // SHARD))
    crowded = crowded_cores(rows, length, phrase, sample, crowd)
    known = materialize(settled_phrases(dictionary_rows(rows, shards, length, phrase, crowded), shards), "phrases", small=True)
    names = known.where("kind = 2").select("part", "row", "doc_id", "text_key")
    runs = known.where("kind = 1").select("part", "row", "start", "starts")
    fetched = fetch(rows, known.where("kind = 0"), names, length)
    runs = runs.unionByName(compared(fetched.where("NOT apart"), shards, length))
    if len(crowded):
        runs = runs.unionByName(counted(fetched.where("apart"), length))
    return cut(rows, runs, names, length)
