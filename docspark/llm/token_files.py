"""Token ids in Arrow files: batches of equal-length sequences and masks, read back without a copy."""

from __future__ import annotations

import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import slices, whole_text
from docspark.session import fresh_path, materialize

LENGTH = 2048
END_ID = 2
BATCH = 256
#: Chunks of text whose ids a worker remembers, about, and their greatest length. Bytes of text encoded at once, or one text.
CACHE, CACHED_CHARS = 300_000, 40
TOGETHER = 1 << 23

MANIFEST = "part int, path string, n_docs long, n_tokens long"


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, as bytes of ids.

    The vocabulary works on chunks that never reach across a single space before a word. Arrow cuts
    texts at spaces and lists the distinct chunks, each is encoded once and remembered, and the
    texts are put together from the list. Chunks of Latin letters, digits and signs are cut into
    the splitter's pieces here and go straight to the library's merges. Texts where a space has
    white space or an end on both sides, or that name a special token, are encoded whole; so are
    all texts if the file has another normaliser or splitter than the byte-level one.
    """

    joined = re.compile(r"\s (?!\S)")
    simple = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)")
    #: Neither an apostrophe, which starts pieces of its own, nor lines without text, whose breaks share one.
    plain = re.compile(r"""(?!\n)(?:[A-Za-zÀ-ÖØ-öø-ɏ0-9!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]|\n(?!\n))++""")
    pieces = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|\n|[^A-Za-zÀ-ÖØ-öø-ɏ0-9\n]+")

    def __init__(self, file: str, kind: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.kind, self.code = kind, {2: "H", 4: "I"}[np.dtype(kind).itemsize]
        with open(file) as source:
            state = json.load(source)
        splitter = state.get("pre_tokenizer") or {}
        self.by_chunk = not state.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        self.special = [x["content"] for x in state.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.by_chunk:
            self.merges = self.tokenizer.model
            self.written = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}
            self.signs = dict(zip(["", *".,;:!?\n"], self.ids(["", *".,;:!?\n"])))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, each after a space.

        Remembered are words and other pieces, under their text where they start a chunk and after a
        space where they do not, and whole chunks that the library cuts.
        """
        if len(self.known) > CACHE // 2:  # what has not been met since the last time is forgotten
            self.older, self.known = self.known, {}
        known, older, signs, written, code, merged = self.known, self.older, self.signs, self.written, self.code, self.merges.tokenize
        simple, plain, findall, ascii_letter = self.simple.fullmatch, self.plain.fullmatch, self.pieces.findall, frozenset(string.ascii_letters).__contains__
        out = list(map(known.get, chunks))
        other = []

        def piece(key: str, text: str, space: str = "") -> bytes:
            if (ids := known.get(key)) is None:
                if (ids := older.get(key)) is None:
                    ids = array(code, [t.id for t in merged(space + (text if text.isascii() else text.translate(written)))]).tobytes()
                if len(key) <= CACHED_CHARS:
                    known[key] = ids
            return ids

        for i in [i for i, ids in enumerate(out) if ids is None]:
            chunk = chunks[i]
            if (sign := signs.get(chunk[-1:])) and (ids := known.get(chunk[:-1])) and ascii_letter(chunk[-2:-1]):
                out[i] = ids + sign
            elif parts := simple(chunk):
                word, sign = parts.groups()
                out[i] = piece(word, word, "Ġ") + signs[sign]
            elif plain(chunk):
                first, *more = findall(chunk)
                out[i] = piece(first, first, "Ġ") + b"".join([signs.get(x) or piece(" " + x, x) for x in more])
            elif (ids := older.get(chunk)) is not None:
                out[i] = known[chunk] = ids
            else:
                other.append(i)
        for i, ids in zip(other, self.ids([" " + chunks[i] for i in other])):
            out[i] = ids
            if len(chunks[i]) <= CACHED_CHARS:
                known[chunks[i]] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [not self.by_chunk or bool(self.joined.search(t)) or any(s in t for s in self.special) for t in texts]
        firsts = self.ids([t if w else t.partition(" ")[0] for t, w in zip(texts, whole)])
        if all(whole):
            return firsts
        split = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), " ")
        listed = split.flatten().dictionary_encode()
        ids = pa.array(self.chunks(listed.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(listed.indices)
        ends = np.frombuffer(ids.buffers()[1], "int64")[ids.offset :]  # chunk k of all lies from ends[k] to ends[k + 1]
        cuts = ends[split.offsets.to_numpy()].tolist()
        starts = ends[split.offsets.to_numpy()[:-1] + 1].tolist()  # a text's first chunk has no space before it
        data = memoryview(ids.buffers()[2] or b"")
        return [first + data[a:b] for first, a, b in zip(firsts, starts, cuts[1:])]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(file: str, kind: str) -> Encoder:
    """One encoder per worker process."""
    if (file, kind) not in _encoders:
        _encoders[file, kind] = Encoder(file, kind)
    return _encoders[file, kind]


class TokenFile:
    """Random access to one file; ids are views of the mapped file where the store is a local disk."""

    def __init__(self, uri: str):
        files, path = pa.fs.FileSystem.from_uri(uri)
        opened = [pa.memory_map(p) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(p) for p in (path + ".tokens.arrow", path + ".docs.arrow")]
        self.sequences = pa.ipc.open_file(opened[0])
        self.documents = pa.ipc.open_file(opened[1])
        meta = self.sequences.schema.metadata
        self.length, self.batch = int(meta[b"length"]), int(meta[b"batch"])

    def ids(self, batch: int) -> np.ndarray:
        """All ids of a batch, a view of its buffer."""
        column = self.sequences.get_batch(batch).column(0)
        return column.values.to_numpy(zero_copy_only=True)[column.offset * self.length : (column.offset + len(column)) * self.length]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence ``i``."""
        at = i % self.batch * self.length
        mask = self.sequences.get_batch(i // self.batch).column(1).values
        return self.ids(i // self.batch)[at : at + self.length], mask.slice(at, self.length)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views of the batches that hold them."""
        size = self.length * self.batch
        while n > 0:
            piece = self.ids(start // size)[start % size : start % size + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def write_file(rows: Iterator[tuple[list, list[bytes]]], uri: str, kind: str, length: int, end_id: int, batch: int) -> tuple[int, int]:
    """Write documents (ids of rows, encoded texts) in the given order; returns their number and tokens."""
    files, path = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    ids_type = pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)
    schema = pa.schema([("ids", ids_type), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "batch": str(batch)})
    index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    end = np.array([end_id], kind).tobytes()
    width, size = np.dtype(kind).itemsize, length * batch * np.dtype(kind).itemsize
    n_docs = n_tokens = 0
    with files.open_output_stream(path + ".tokens.arrow") as a, files.open_output_stream(path + ".docs.arrow") as b:
        with pa.ipc.new_file(a, schema) as out, pa.ipc.new_file(b, index) as docs:

            def put(data: bytes, n: int) -> None:
                mask = np.arange(len(data) // width) < n
                lists = [pa.FixedSizeListArray.from_arrays(x, length) for x in (pa.array(np.frombuffer(data, kind)), pa.array(mask))]
                out.write_batch(pa.record_batch([x.cast(f.type) for x, f in zip(lists, schema)], schema=schema))

            held = bytearray()
            for doc_ids, encoded in rows:
                counts = np.array([len(e) // width + 1 for e in encoded], "int64")
                starts = n_tokens + np.cumsum(counts) - counts
                docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=index))
                n_docs, n_tokens = n_docs + len(counts), n_tokens + int(counts.sum())
                for e in encoded:
                    held += e
                    held += end
                    if len(held) >= size:
                        whole = len(held) // size * size
                        for k in range(0, whole, size):
                            put(bytes(held[k : k + size]), length * batch)
                        del held[:whole]
            if held:
                n = len(held) // width
                put(bytes(held) + end * (-n % length), n)
    return n_docs, n_tokens


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: int = 50_257, batch: int = BATCH) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and write all ids in ascending order of the id.

    Each partition of the ordered documents becomes one Arrow file of record batches with two
    fixed-size lists per row, ids and mask (false where the last sequence is filled up), and one
    with each document's place. Ids take two bytes if the vocabulary allows. A task writes under a
    name of its own, and only files of the task that succeeded are in the result, so a repeated
    task does no harm. ``folder`` is one that every executor reaches.

    Returns the manifest ``part, path, n_docs, n_tokens``: one row per file that has documents. A
    null text is empty and gives the end id alone; null ids come first; equal ids are ordered by
    text. An empty table gives no files; other columns are not read.
    """
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ranged = rows.repartitionByRange(max(1, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer, kind).encode

        def encoded() -> Iterator[tuple[list, list[bytes]]]:
            held = first
            while held is not None:
                for some in slices(held, 1, TOGETHER):
                    yield some.column(0).to_pylist(), encode(some.column(1).to_pylist())
                held = next(batches, None)

        n_docs, n_tokens = write_file(encoded(), uri, kind, length, end_id, batch)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return materialize(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32, part``.

    ``start`` counts the ids of all documents before it. The files' offsets are running sums over
    the manifest, one row per file.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = placed.repartition(max(1, min(manifest.count(), 10_000)), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for row in table.to_pylist():
                file = TokenFile(row["path"])
                for k in range(file.documents.num_record_batches):
                    docs = file.documents.get_batch(k)
                    sums = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc = 0
                        for piece in file.span(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + row["base"])
                    parts = pa.array(np.full(docs.num_rows, row["part"], "int32"))
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(sums, pa.int64()), parts], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def token_report(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files below the shared folder and report every document from them."""
    return read_token_files(write_token_files(docs, tokenizer, fresh_path(spark, "token-files"), **options))
