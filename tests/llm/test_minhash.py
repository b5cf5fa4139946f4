import collections
import itertools
import random

import numpy as np
from odd_rows import ODD

from docspark.llm.minhash import first_of_each, laid_rows, near_duplicates, signatures


def bag(text):
    w = (text or "").encode().lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain(rows):
    """Classes as sets of row numbers."""
    bags = [bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bags[i] and similarity(bags[i], bags[j]) >= 0.8:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def check(rows, df):
    found = near_duplicates(df)
    assert found.columns == ["doc_id", "text_key", "class_id", "class_size", "kept"]
    classes = collections.defaultdict(list)
    for (d, *_), c in zip(rows, plain(rows)):
        classes[c].append(d)
    expected = sorted([(d, min((x for x in own if x is not None), default=None), len(own)) for own in classes.values() for d in own], key=str)
    got = found.collect()
    assert sorted([(r.doc_id, r.class_id, r.class_size) for r in got], key=str) == expected
    return got, classes


def test_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    element = np.arange(1, 61, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    a[:20], b[40:] = 1, 0
    size = 4096
    both = signatures(np.concatenate([element, element[b > 0]]), np.repeat([0, 1], [60, 40]), np.concatenate([a, b[b > 0]]), 2, size)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / size)


def test_odd_rows(odd, documents):
    got, _ = check(ODD, odd)
    assert all(r.kept for r in got if r.class_size == 1)
    assert near_duplicates(documents([])).count() == 0


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_of_copies(documents):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 120))), "s") for i in range(150)]
    for k in range(12):
        source = [word() for _ in range(rng.randint(30, 150))]
        rows += [(1000 + 100 * k + j, edited(source, rng.randint(0, 1 + len(source) // 30), rng), "s") for j in range(rng.randint(2, 8))]
    rows += [(5000 + j, rows[3][1].upper(), "s") for j in range(30)]
    rng.shuffle(rows)
    docs = documents(rows).repartition(5)
    got, classes = check(rows, docs)
    kept = first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(own) for own in classes.values())


def test_a_large_group_of_unlike_copies(documents):
    rng = random.Random(5)
    source = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, edited(source, rng.randint(0, 9), rng), "s") for i in range(300)]
    check(rows, documents(rows).repartition(6))


def test_a_chain_is_one_class(documents):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100]), "s") for i in range(40)]
    got, classes = check(rows, documents(rows))
    assert len(classes) == 1 and got[0].class_size == 40


def test_a_stray_costs_one_copy_of_its_bucket(spark):
    key = lambda i: i.to_bytes(16, "big")
    members = [(key(i), 0, b"hot", key(0)) for i in range(5001)] + [(key(9000 + i), 1, key(i // 2), key(9000 + i // 2 * 2)) for i in range(40)]
    crowded = spark.createDataFrame(members, "bag binary, band int, key binary, leader binary")
    roots = spark.createDataFrame([(key(i), key(0)) for i in range(5000)], "node binary, root binary")
    laid = laid_rows(crowded, roots)
    assert laid.where("asks").select("bag").distinct().count() == 1
    assert laid.count() <= 5001 + 5  # the leader and all buckets of two stay out
    cells = laid.groupBy("i", "j").agg({"bag": "count"}).collect()
    assert len(cells) == 5 and max(c[2] for c in cells) < 1300
