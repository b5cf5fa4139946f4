"""Benchmark decontamination: passages query an inverted index of test items with block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import KEY, keyed, matched, slices, whole_text
from docspark.session import materialize

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its shingles that must be there.
THRESHOLD, OVERLAP, PART_OVERLAP = 0.5, 0.8, 0.5
SHINGLE = 5
POSTINGS_BLOCK = 8
#: Bytes of item texts in one index.
INDEX_BYTES = 8 << 20

WORDS = re.compile(r"\w+")
ANSWER = re.compile(r"(?s)^(.*[.?!\n])\s*(\S.*)$")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def item_shingles(text: str) -> tuple[set, set]:
    """Word 5-grams of an item: those that end in the question, and those that end in the answer.

    The answer is the last sentence or line of an item that has several. An item of fewer words
    than a shingle is one shingle.
    """
    parts = ANSWER.match(text.strip())
    question = len(words(parts[1])) if parts else None
    tokens = words(text)
    size = min(SHINGLE, len(tokens))
    grams = [(tuple(tokens[i : i + size]), i + size) for i in range(len(tokens) - size + 1)] if tokens else []
    if question is None:
        return {g for g, _ in grams}, set()
    return {g for g, end in grams if end <= question}, {g for g, end in grams if end > question}


class ItemIndex:
    """Inverted index of one block of items: postings by item, in blocks with their greatest impact.

    Impacts are BM25 contributions divided by the item's score for itself, so one threshold holds
    for all items. Terms are split in common ones, whose impacts together stay below the threshold
    in every item, and telling ones; an item can only reach the threshold by telling terms.
    """

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_words: float, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items = sorted((i, t) for i, t in items if words(t))
        self.shingles = [item_shingles(t) for _, t in self.items]
        self.longest = max([len(words(t)) for _, t in self.items], default=0)
        weigh = {t: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(self.items):
            counts = Counter(words(text))
            long = K1 * (1 - B + B * sum(counts.values()) / mean_words)
            score = {t: weigh[t] * n * (K1 + 1) / (n + long) for t, n in counts.items()}
            own = sum(score.values())
            for t, s in score.items():
                postings.setdefault(t, []).append((k, s / own))
        self.terms = {t: i for i, t in enumerate(sorted(postings))}
        self.docs = [np.array([k for k, _ in postings[t]], "int64") for t in self.terms]
        self.impacts = [np.array([s for _, s in postings[t]]) for t in self.terms]
        self.greatest = np.array([x.max() for x in self.impacts])
        starts = [range(0, len(x), POSTINGS_BLOCK) for x in self.docs]
        self.block_greatest = [np.maximum.reduceat(x, list(s)) for x, s in zip(self.impacts, starts)]
        self.block_last = [np.array([x[min(a + POSTINGS_BLOCK, len(x)) - 1] for a in s]) for x, s in zip(self.docs, starts)]
        common = np.zeros(len(self.items))
        telling = np.ones(len(self.terms), bool)
        for i in sorted(range(len(self.terms)), key=lambda i: -len(self.docs[i])):
            more = common[self.docs[i]] + self.impacts[i]
            if (more < threshold / 2).all():
                common[self.docs[i]] = more
                telling[i] = False
        self.telling, self.needed = telling, threshold - common - 1e-9
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.docs])]).astype("int64")
        self.flat_docs = np.concatenate([*self.docs, np.zeros(0, "int64")])
        self.flat_impacts = np.concatenate([*self.impacts, np.zeros(0)])

    def promising(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages in which some item's telling terms alone can lift it over the threshold.

        ``passage`` and ``term`` list the distinct terms of each passage.
        """
        use = self.telling[term]
        passage, term = passage[use], term[use]
        n = self.offsets[term + 1] - self.offsets[term]
        at = np.repeat(self.offsets[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair, inverse = np.unique(np.repeat(passage, n) * len(self.items) + self.flat_docs[at], return_inverse=True)
        score = np.bincount(inverse, weights=self.flat_impacts[at], minlength=len(pair))
        return np.unique(pair[score >= self.needed[pair % len(self.items)]] // len(self.items))

    def search(self, terms: list[int]) -> list[int]:
        """All items whose score for a passage with these distinct terms is at least the threshold.

        Block-max WAND: cursors in order of their items; the pivot is the first cursor at which the
        terms' greatest impacts add up to the threshold. If the blocks' greatest impacts up to it
        do not, the cursors jump behind the nearest end of a block; else the pivot is scored.
        """
        least, found = self.threshold - 1e-9, []
        cursors = [[int(self.docs[t][0]), t, 0] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.greatest[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks, ends = 0.0, []
            for _, t, _ in cursors[: pivot + 1]:
                b = int(np.searchsorted(self.block_last[t], item))
                if b < len(self.block_last[t]):
                    blocks += self.block_greatest[t][b]
                    ends.append(int(self.block_last[t][b]) + 1)
            if blocks < least:
                target = min([*ends, *(c[0] for c in cursors[pivot + 1 : pivot + 2])])
            elif cursors[0][0] < item:
                target = item
            else:
                if sum(self.impacts[t][at] for _, t, at in cursors[: pivot + 1]) >= least:
                    found.append(item)
                target = item + 1
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    c[2] += int(np.searchsorted(self.docs[c[1]][c[2] :], target))
                    c[0] = int(self.docs[c[1]][c[2]]) if c[2] < len(self.docs[c[1]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verified(self, item: int, tokens: list[str]) -> float:
        """Share of the item's shingles among the words; 0 if too few, of the whole or of one part."""
        question, answer = self.shingles[item]
        size = len(next(iter(question or answer)))
        there = {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}
        hits = len(question & there), len(answer & there)
        enough = all(h >= PART_OVERLAP * len(part) for h, part in zip(hits, (question, answer)))
        share = sum(hits) / (len(question) + len(answer))
        return share if enough and share >= OVERLAP else 0.0

    def leaks(self, texts: list[str]) -> list[dict[int, float]]:
        """Per whole text the items found in it, with the verified share of their shingles.

        Passages are as long as two of the longest items and start at every one, so whatever is as
        long as an item lies inside one.
        """
        stride = max(self.longest, 1)
        all_words, owner, place, term = [], [], [], []
        found: list[dict[int, float]] = [{} for _ in texts]
        if not self.items:
            return found
        known = self.terms
        for d, text in enumerate(texts):
            tokens = words(text)
            all_words.append(tokens)
            hits = [(i, known[w]) for i, w in enumerate(tokens) if w in known]
            if hits:
                at, ids = zip(*hits)
                owner.append(np.full(len(at), d, "int64"))
                place.append(np.array(at, "int64"))
                term.append(np.array(ids, "int64"))
        if not owner:
            return found
        owner, place, term = map(np.concatenate, (owner, place, term))
        window = place // stride
        width = int(window.max()) + 2
        passage = owner * width + window + 1
        listed = np.unique(np.concatenate([passage, passage - 1]) * len(known) + np.concatenate([term, term]))
        passages, terms = listed // len(known), listed % len(known)
        for p in self.promising(passages, terms):
            a, b = np.searchsorted(passages, [p, p + 1])
            d, first = int(p // width), (int(p % width) - 1) * stride
            for item in self.search(terms[a:b].tolist()):
                number = self.items[item][0]
                if number not in found[d]:
                    share = self.verified(item, all_words[d][max(0, first) : first + 2 * stride])
                    if share:
                        found[d][number] = share
        return found


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES):
    """Indexes over blocks of items of about ``index_bytes`` each; term statistics are those of all items."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), whole_text(text_col).alias("text")).where("item IS NOT NULL")
    rows = materialize(rows.groupBy("item", "text").count().select("item", "text"), "items")
    total, n_items = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, math.ceil((total or 0) / index_bytes))

    def listed(batches):
        for frame in batches:
            pairs = [(w, n) for t in frame["text"] for w, n in Counter(words(t)).items()]
            yield pd.DataFrame({"term": [w for w, _ in pairs], "n": [n for _, n in pairs]})

    counts = materialize(rows.mapInPandas(listed, "term string, n long").groupBy("term").agg(F.count("*").alias("items"), F.sum("n").alias("n")), "item-terms")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / max(1, n_items)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        texts = [(r["item"], r["text"]) for r in part.collect()]
        terms = part.mapInPandas(listed, "term string, n long").select("term").distinct()
        yield ItemIndex(texts, {r["term"]: r["items"] for r in counts.join(terms, "term").collect()}, n_items, mean)


def searching(index: ItemIndex):
    """The search of one index as a step over Arrow batches of ``doc_id, text_key, text``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hits = [(i, item, share) for i, x in enumerate(index.leaks(part.column(2).to_pylist())) for item, share in sorted(x.items())]
                at = pa.array([i for i, _, _ in hits], pa.int64())
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "item", "overlap"])

    return search


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Documents that hold a test item: ``doc_id, text_key, item, overlap``, a row per document and item.

    The items are the stated query set. They are indexed in blocks of a fixed number of bytes, and
    each block's index goes to all tasks, which cut every whole text into overlapping passages,
    search the index with each and verify by word 5-grams that question and answer are there. No
    document is shuffled.
    """
    rows = keyed(docs, id_col, text_col)
    found = None
    for index in build_indexes(items, index_bytes=index_bytes):
        hits = rows.mapInArrow(searching(index), "doc_id long, text_key long, item long, overlap double")
        found = hits if found is None else found.unionByName(hits)
    return materialize(found.distinct(), "leaks")


def leak_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, contaminated, items, overlap`` per input row: ids of the items found, greatest overlap.

    A null text is empty and has none; items without words or id are passed over; rows that agree
    in id and text get one result each; empty tables of items or documents find nothing. Other
    columns are not read.
    """
    hits = find_leaks(docs, items, id_col, text_col).groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("overlap").alias("overlap"))
    rows = keyed(docs, id_col, text_col).select(*KEY)
    return matched(rows, hits, KEY, "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("overlap", F.lit(0.0)).alias("overlap")
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item was found."""
    hits = find_leaks(docs, items, id_col, text_col).select(*KEY).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col), F.lit(1)).alias("text_key"))
    return matched(rows, hits, KEY, "left_anti").select("row.*")
