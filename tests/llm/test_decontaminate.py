import random

import numpy as np
import pytest
from odd_rows import ODD

from docspark.llm.decontaminate import ItemIndex, build_indexes, clean_documents, item_shingles, leak_report, words


@pytest.fixture(scope="module")
def items():
    random.seed(4)
    common = ["the", "of", "and", "a", "to"]
    word = lambda: random.choice(common) if random.random() < 0.4 else f"w{random.randint(0, 400)}"
    return [(i, " ".join(word() for _ in range(random.randint(4, 40))) + ". " + " ".join(word() for _ in range(random.randint(1, 8))) + ".") for i in range(80)]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    rows = [*items, (900, None), (901, ""), (None, "no id here at all"), items[0]]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, item string")


def test_search_finds_all_above_the_threshold(benchmark):
    (index,) = build_indexes(benchmark)
    random.seed(0)
    for _ in range(300):
        index.threshold = random.choice([0.05, 0.1, 0.2, 0.5])
        own = [index.terms[w] for w in set(words(random.choice(index.items)[1]))]
        terms = sorted({*own, *random.sample(range(len(index.terms)), random.randint(1, 60))})
        score = np.zeros(len(index.items))
        for t in terms:
            score[index.docs[t]] += index.impacts[t]
        assert index.search(terms) == np.flatnonzero(score >= index.threshold - 1e-9).tolist()


def test_promising_passages_include_all_above_the_threshold(benchmark):
    (index,) = build_indexes(benchmark)
    random.seed(1)
    for _ in range(100):
        terms = np.array(sorted({index.terms[w] for w in random.sample(words(random.choice(index.items)[1]), 3)} | set(random.sample(range(len(index.terms)), 20))))
        if index.search(terms.tolist()):
            assert index.promising(np.zeros(len(terms), "int64"), terms).tolist() == [0]


def plain(rows, items):
    out = []
    for d, t, *_ in rows:
        w = words(t or "")
        found = []
        for i, text in items:
            question, answer = item_shingles(text)
            size = len(next(iter(question or answer)))
            there = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            hits = len(question & there), len(answer & there)
            if sum(hits) >= 0.8 * len(question | answer) and all(h >= 0.5 * len(p) for h, p in zip(hits, (question, answer))):
                found.append(i)
        out.append((d, bool(found), sorted(found)))
    return sorted(out, key=str)


def planted(items):
    random.seed(6)
    noise = lambda n: " ".join(random.choice(["the", "of", "zz", "yy", f"w{random.randint(0, 400)}"]) for _ in range(n))
    rows = [(i, noise(random.randint(0, 200)), "s") for i in range(100)]
    rows += [(200 + i, f"{noise(70)} {t.upper()} {noise(40)}", "s") for i, t in items]
    rows += [(400 + i, f"{noise(10)} {t.rsplit('.', 2)[0]} {noise(10)}", "s") for i, t in items]  # the question alone
    return rows + ODD


def test_leaks(documents, benchmark, items):
    rows = planted(items)
    docs = documents(rows)
    report = leak_report(docs, benchmark)
    assert report.columns == ["doc_id", "contaminated", "items", "overlap"]
    got = sorted([(r.doc_id, r.contaminated, sorted(r["items"])) for r in report.collect()], key=str)
    assert got == plain(rows, items)
    assert all(200 + i in {d for d, hit, _ in got if hit} for i, _ in items)
    clean = clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([d for d, hit, _ in got if not hit], key=str)


def test_several_indexes_find_the_same(documents, benchmark, items):
    assert len(list(build_indexes(benchmark, index_bytes=1500))) > 3
    from docspark.llm.decontaminate import find_leaks

    docs = documents(planted(items)[:150])
    one, many = (sorted(map(tuple, find_leaks(docs, benchmark, index_bytes=n).select("doc_id", "item").collect())) for n in (1 << 20, 1500))
    assert one and one == many


def test_empty_tables(documents, benchmark):
    assert leak_report(documents([]), benchmark).count() == 0
    assert {r.contaminated for r in leak_report(documents(ODD), benchmark.limit(0)).collect()} == {False}
    assert ItemIndex([], {}, 0, 0).leaks(["a b"]) == [{}]
