import hashlib
import random
import re

from odd_rows import ODD

from docspark.llm.exact import exact_duplicates


def plain(rows):
    groups = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        bare = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id is None, doc_id, i))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(doc_id, best[2], len(members), hashlib.sha256(bare.encode()).hexdigest()) for _, _, doc_id, _ in members]
    return sorted(out, key=str)


def check(rows, df):
    found = exact_duplicates(df)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = found.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == plain(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in got})


def test_odd_rows(odd, documents):
    check(ODD, odd)
    assert exact_duplicates(documents([])).count() == 0


def test_many_partitions_and_a_large_group(spark, documents):
    random.seed(3)
    rows = [(i, random.choice(["same text", "same  text", f"text {i % 40}"]), "s") for i in range(600)]
    check(rows, documents(rows).repartition(20))
