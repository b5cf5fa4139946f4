import hashlib
import zlib

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from docspark.llm import merkle
from docspark.llm.merkle import audit, butterfly, leaf_digest, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root, and per leaf the siblings level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            first = i - i % 3
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    """Rows ``doc_id, source, leaf, now`` -> the manifest's."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[name] = plain_tree([r[2] for r in groups[name]])
    root, tops = plain_tree([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for row, path in zip(groups[name], trees[name][1]):
            path, folded = path + top, row[3]
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], row[2], trees[name][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def found(leaves):
    got = audit(manifest(leaves, carry=["now"]), "now")
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def check(df, rows):
    bare = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = df.select("doc_id", "source", leaf_digest(FIELDS).alias("leaf"), leaf_digest(FIELDS, text=bare).alias("now"))
    want = []
    for doc_id, text, source in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        now = text.replace("\n", "") if text is not None and even else text
        want.append((doc_id, source, plain_leaf((doc_id, source, "en", 0, text)), plain_leaf((doc_id, source, "en", 0, now))))
    assert found(leaves) == plain(want)


def test_odd_rows(odd, documents):
    check(odd, ODD)
    check(documents(ODD[:1]), ODD[:1])
    assert found(documents([]).select("doc_id", "source", F.lit("x").alias("leaf"), F.lit("x").alias("now"))) == []


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "CHUNK", 3)


def test_groups_of_every_size(documents, small_chunks):
    sizes = [1, 2, 3, 4, 5, 9, 10, 11, 27, 28, 29, 31, 55, 82, 100]
    rows = [(1000 * n + 7 * i % 1000, f"text\n{i}", None if n == 5 else f"s{n}") for n in sizes for i in range(n)]
    check(documents(rows).repartition(7), rows)


def test_a_hot_group_of_equal_rows(documents, small_chunks):
    rows = [(5, "the same\ntext", "s")] * 60 + [(None, None, "s")] * 30 + [(i, f"t{i}", "s") for i in range(20)]
    check(documents(rows), rows)


def test_no_group_of_a_round_is_large(spark):
    nodes = spark.range(50).select(F.lit(0).alias("t"), F.col("id").alias("place"), F.lit(50).cast("long").alias("places"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    got = butterfly(nodes, "t").collect()
    root, paths = plain_tree([sha(str(i)) for i in range(50)])
    assert {r.root for r in got} == {root} and len(got) == 50
    assert [[tuple(p) for p in r.path] for r in sorted(got, key=lambda r: r.place)] == paths


def test_any_change_is_seen(documents):
    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(40)]
    df = documents(rows)
    leaves = df.select("doc_id", "source", leaf_digest(FIELDS).alias("leaf"), F.when(F.col("doc_id") == 7, F.lit("0" * 64)).otherwise(leaf_digest(FIELDS)).alias("now"))
    assert [r[0] for r in found(leaves) if not r[-1]] == [7]
