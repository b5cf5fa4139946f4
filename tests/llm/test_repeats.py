import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD

from docspark.llm import repeats
from docspark.llm.repeats import remove_repeats


def plain(rows, length):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    counts = collections.Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, "uint8")[~gone])).hexdigest()))
    return sorted(out, key=str)


def check(rows, df, length=200, **options):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(df, length=length, **options).collect()]
    assert sorted(got, key=str) == plain(rows, length)


def corpus(n=160):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdé", k=random.randint(1, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(random.randint(0, 40)))]
        if i % 2:
            p = random.choice(passage)
            a = random.randint(0, 60)
            parts += [p[a : a + random.randint(60, 250)], " ".join(word() for _ in range(random.randint(0, 30)))]
        if i % 17 == 0:
            parts.append("-" * random.randint(150, 420))
        rows.append((i, " ".join(parts), "s"))
    return rows + [(1000 + i, rows[5][1], "s") for i in range(20)]


@pytest.mark.parametrize("options", [{}, {"sample": 1, "crowd": 2}])
def test_against_every_string(documents, options):
    rows = corpus()
    check(rows, documents(rows).repartition(4), **options)


def test_short_strings(documents):
    rows = corpus(60)
    check(rows, documents(rows).repartition(3), length=40, phrase=10)


def test_odd_rows(odd, documents):
    check(ODD, odd)
    assert remove_repeats(documents([])).count() == 0


def test_long_texts_are_parsed_in_pieces(monkeypatch):
    text = "".join(random.Random(2).choices("abc ", k=5000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode(), "x", text.decode()[:2000]])], ["text"])

    def places():
        found = list(repeats.parsed(batch, 0, 200, 100))
        return {(int(t), int(s) + k) for f in found for t, s, n in zip(f["text"], f["start"], f["starts"]) for k in range(n)}

    whole = places()
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert places() == whole and len(whole) == 5000 - 199 + 2000 - 199


def test_suffix_ranks():
    data = np.frombuffer(b"abracadabra abracadabra abr", "uint8")
    for length in (1, 3, 8, 9, 13):
        strings = [bytes(data[i : i + length]) for i in range(len(data) - length + 1)]
        order = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert repeats.suffix_ranks(data, length).tolist() == [order[s] for s in strings]


def test_suffixes_are_ranked_some_cores_at_a_time(spark):
    """Cores stay whole whatever the batches, no group is larger than asked but for one core, and the strings found are the same."""
    rng = random.Random(11)
    rows = []
    for core in range(60):
        base = bytes(rng.randrange(97, 100) for _ in range(40))
        for i in range(rng.choice([1, 2, 3, 9])):
            data = base[: 20 + rng.randrange(12)] if rng.random() < 0.7 else bytes(rng.randrange(97, 100) for _ in range(25))
            rows.append((core - 30, rng.random() < 0.8, 0, len(rows), 5, len(data) - 19, bytearray(data)))
    schema = "core long, asks boolean, part int, row long, start long, starts int, data binary"
    texts = spark.createDataFrame(rows, schema)
    whole = sorted(map(tuple, repeats.compared(texts, 1, 20, 1 << 30).collect()))
    assert len(whole) > 60
    assert sorted(map(tuple, repeats.compared(texts, 3, 20, 100).collect())) == whole
    columns = ["core", "asks", "part", "row", "start", "starts"]
    table = pa.table({k: list(v) for k, v in zip([*columns, "data"], zip(*rows))})
    table = table.set_column(5, "starts", table.column("starts").cast(pa.int32()))
    size = lambda t: sum(len(d) for d in t.column("data").to_pylist())
    for chunk in (1, 7, 1000):
        groups = list(repeats.core_groups(iter(table.to_batches(max_chunksize=chunk)), 20, 300))
        assert pa.concat_tables(groups).to_pylist() == table.to_pylist()
        cores = [set(g.column("core").to_pylist()) for g in groups]
        assert sum(map(len, cores)) == 60 and len(groups) > 10
        assert all(size(g) <= 300 or len(c) == 1 for g, c in zip(groups, cores))


def test_shards_follow_the_bytes_and_not_the_splits(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abc", k=300)), None) for i in range(20)] + [(90, None, None)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, other string").coalesce(1)
    seen, settle = [], repeats.settled_phrases
    monkeypatch.setattr(repeats, "settled_phrases", lambda found, shards: seen.append(shards) or settle(found, shards))
    one = sorted(map(tuple, remove_repeats(df).collect()))
    monkeypatch.setattr(repeats, "SHARD", 1000)
    assert sorted(map(tuple, remove_repeats(df).collect())) == one
    assert seen == [1, 7] and sum(r[2] > 0 for r in one) == 6
