import collections

from odd_rows import ODD

from docspark.llm.mixing import mix_documents, mixed_sizes


def test_odd_rows(odd, documents):
    rows = mixed_sizes(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), len((t or "").split())) for d, t, _ in ODD)
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in rows)
    assert mixed_sizes(documents([])).count() == 0


def test_targets_share_the_excess(documents):
    # sizes 100, 100, 800 weigh 3, 1, 2: the first is full at 200; the rest shares 1300 by 1 and 2: 200 full, 1100 left
    rows = [(i, "w " * 10, "a") for i in range(10)] + [(100 + i, "w " * 10, "b") for i in range(10)] + [(200 + i, "w " * 10, "c") for i in range(80)]
    got = mixed_sizes(documents(rows), documents([]).selectExpr("doc_id", "1 AS quality")).collect()
    targets = {r.source_size: set() for r in got}
    taken = collections.Counter()
    for r in got:
        targets[r.source_size].add(round(r.target, 6))
        taken[r.doc_id // 100 if r.doc_id < 200 else 2] += r.taken
    assert targets == {100: {200.0}, 800: {1100.0}}
    assert taken == {0: 200, 1: 200, 2: 1100}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed_sizes(documents(rows).repartition(7)).collect()))


def test_quality_draws_documents_earlier(documents, spark):
    rows = [(i, "w " * 10, "s" if i < 4000 else "t") for i in range(4400)]
    quality = spark.createDataFrame([(i, i % 2) for i in range(4400)], "doc_id long, quality int")
    got = {r.doc_id: r.copies for r in mixed_sizes(documents(rows, False), quality, weights=(1, 1), share=0.5).collect()}
    good, poor = (sum(got[i] for i in range(4000) if i % 2 == k) for k in (1, 0))
    assert good > 1.4 * poor > 0


def test_mix_lists_whole_rows(odd):
    sizes = collections.Counter()
    for r in mixed_sizes(odd).collect():
        sizes[r.doc_id] += r.copies
    mixed = mix_documents(odd)
    assert mixed.columns == odd.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +sizes
