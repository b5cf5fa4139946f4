"""Merkle manifest of a dataset: subtrees swap their roots in butterfly rounds until each holds its whole proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.operators.numbering import number_rows
from docspark.session import materialize

FANOUT = 3
#: Levels of the tree within one chunk of leaves.
DEPTH = 6
CHUNK = FANOUT**DEPTH
PATH = "array<struct<l: string, r: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` for null, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[str], **other: Column) -> Column:
    """Digest of a row's columns in the given order; ``other`` puts an expression in place of a column."""
    return digest(F.concat(*[field(other.get(c, F.col(f"`{c}`"))) for c in columns]))


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def parents(nodes: Column) -> Column:
    """Digests of the runs of ``FANOUT`` nodes; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(joined(F.slice(nodes, i * FANOUT + 1, FANOUT))))


def siblings(nodes: Column, place: Column) -> Column:
    """What stands left and right of ``place`` among the nodes of its run."""
    first = place - place % FANOUT
    return F.struct(
        joined(F.slice(nodes, first + 1, place - first)).alias("l"),
        joined(F.slice(nodes, place + 2, first + FANOUT - 1 - place)).alias("r"),
    )


def butterfly(nodes: DataFrame, tree: str) -> DataFrame:
    """Give every place of every tree the digests beside its way to the root, and the root.

    ``nodes`` has ``tree, place, places, node``: places count from 0 to ``places`` - 1. In round ``r`` a
    place holds the root of the ``3 ** r`` places around it. It swaps that with the places that differ
    from it in digit ``r`` only and hashes their parent for itself, as the others do for themselves: no
    digest ever goes back down. At the right edge, where a subtree has fewer places than its
    neighbours, its places take turns in sending to the neighbours' surplus ones. A group of a round
    has at most ``3`` senders, whatever the size of the tree.

    Returns ``tree, place, root, path``; ``path`` has a struct ``l, r`` per level, from below.
    """
    deepest = nodes.agg(F.max("places")).first()[0] or 0
    state = nodes.select(tree, "place", "places", "node", F.array().cast(PATH).alias("path"))
    width = 1
    while width < deepest:
        mine = F.least(F.lit(width), F.col("places") - F.col("m") * width)
        most = F.least(F.lit(width), F.col("places") - F.col("run") * FANOUT * width)
        held = state.select("*", F.expr(f"place div {width}").alias("m"), F.expr(f"place div {FANOUT * width}").alias("run"))
        held = held.select("*", (F.col("place") % width).alias("low"), mine.alias("mine"), most.alias("most"))
        sent = held.select("*", F.explode(F.sequence("low", F.col("most") - 1, "mine")).alias("to"))
        own = F.when(F.col("to") == F.col("low"), F.struct("place", "path"))
        group = sent.groupBy(tree, "places", "run", "to").agg(
            F.array_sort(F.collect_list(F.struct("m", "node"))).alias("nodes"), F.collect_list(own).alias("own")
        )
        group = group.select(tree, "places", "run", F.transform("nodes", lambda x: x["node"]).alias("nodes"), F.inline("own"))
        at = F.expr(f"int(place div {width} - {FANOUT} * run)")
        going = F.col("places") > width
        state = group.select(
            tree,
            "place",
            "places",
            F.when(going, digest(joined(F.col("nodes")))).otherwise(F.get("nodes", F.lit(0))).alias("node"),
            F.when(going, F.concat("path", F.array(siblings(F.col("nodes"), at)))).otherwise(F.col("path")).alias("path"),
        )
        width *= FANOUT
    return state.select(tree, "place", F.col("node").alias("root"), "path")


def placed(leaves: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """Add ``rank``, each leaf's number within its group, and ``n``, the group's size.

    The leaves are ranged into sorted partitions and numbered through; a small table has the first number
    and the offset of each group in each partition. The last key tells equal rows apart, so that
    a partition need not hold all of them.
    """
    rows = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = [F.asc_nulls_first(group), F.asc_nulls_first(order), F.asc(leaf), F.asc("_row")]
    ranged = rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "ranged")
    sizes = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    all_of = W.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(all_of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(all_of).alias("n"))
    match = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))
    return ranged.join(sizes, match).select(*[c for c in leaves.columns], (F.col("_at") + F.col("_shift")).alias("rank"), "n")


def chunks(rows: DataFrame, group: str, items: list[str], leaf: str) -> DataFrame:
    """A row per chunk of ``CHUNK`` neighbouring leaves: ``group, place, places, items, levels, node``.

    A chunk that is its whole group ends at its single node; others are all hashed ``DEPTH`` levels up.
    """
    whole = F.struct("rank", *items, leaf)
    cut = rows.select("*", F.expr(f"rank div {CHUNK}").alias("place"))
    packed = cut.groupBy(group, "place").agg(F.array_sort(F.collect_list(whole)).alias("items"), F.first("n").alias("n"))
    packed = packed.select("*", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}").alias("places"), F.transform("items", lambda x: x[leaf]).alias("level0"))
    for k in range(DEPTH):
        on = (F.col("places") > 1) | (F.size(f"level{k}") > 1)
        packed = packed.withColumn(f"level{k + 1}", F.when(on, parents(F.col(f"level{k}"))).otherwise(F.array().cast("array<string>")))
    levels = F.filter(F.array(*[f"level{k}" for k in range(DEPTH + 1)]), lambda x: F.size(x) > 0)
    packed = packed.select(group, "place", "places", "items", levels.alias("levels"))
    return packed.select("*", F.get(F.element_at("levels", -1), F.lit(0)).alias("node"))


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf", carry: list[str] | None = None) -> DataFrame:
    """Merkle tree over leaf digests: a tree per group, in order, and one over the groups' roots.

    Three consecutive nodes, or what is left at the end of a level, become one. Chunks of leaves are
    the partitions of the exchange: each hashes its own subtree, then ``butterfly`` rounds run over
    the chunks of a group, and over the groups. A group of a third of all rows is many chunks, and no
    task holds more than one chunk's leaves or a run's three nodes.

    ``group`` is text, ``order`` a column that can be sorted, ``leaf`` lowercase hex. Nulls come first in
    both; rows that agree in both stand by their leaf, and equal ones in any order. Returns ``order, group,
    leaf``, the columns of ``carry``, ``subroot``, ``root`` and ``path``, a struct ``l, r`` of the
    digests left and right of the way, per level from the leaf, a row per input row. A single leaf
    is its root, with an empty path. An empty table gives no rows. Columns of other names are not read.
    """
    carry = list(carry or [])
    rows = leaves.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{order}`").alias("_o"), F.col(f"`{leaf}`").alias("_leaf"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("_carry"))
    packed = materialize(chunks(placed(rows, "_g", "_o", "_leaf"), "_g", ["_o", "_carry"], "_leaf"), "chunks")
    parts = materialize(butterfly(packed.select("_g", "place", "places", "node"), "_g"), "proofs")
    groups = number_rows(parts.groupBy("_g").agg(F.min("root").alias("node")), [F.asc_nulls_first("_g")], "place", 1)
    groups = materialize(groups, "groups")
    top = butterfly(groups.select("place", F.lit(groups.count()).cast("long").alias("places"), "node", F.lit(0).alias("_t")), "_t")
    groups = groups.join(top.withColumnRenamed("path", "_top"), "place").select(F.col("_g").alias("_h"), F.col("node").alias("subroot"), F.col("root").alias("_root"), "_top")
    proofs = parts.join(groups, F.col("_g").eqNullSafe(F.col("_h"))).select("_h", F.col("place").alias("_p"), "subroot", "_root", F.concat("path", "_top").alias("_upper"))
    proofs = materialize(proofs, "proofs")
    found = packed.join(proofs, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("place") == F.col("_p")))
    each = found.select("_g", "levels", "subroot", "_root", "_upper", F.posexplode("items").alias("_i", "_item"))
    widths = F.array(*[F.lit(FANOUT**k) for k in range(DEPTH + 1)])
    steps = F.slice("levels", 1, F.size("levels") - 1)
    lower = F.transform(steps, lambda nodes, k: siblings(nodes, F.floor(F.col("_i") / F.get(widths, k)).cast("int")))
    return each.select(
        F.col("_item._o").alias(order),
        F.col("_g").alias(group),
        F.col("_item._leaf").alias(leaf),
        *[F.col("_item._carry").getField(c).alias(c) for c in carry],
        "subroot",
        F.col("_root").alias("root"),
        F.concat(lower, "_upper").alias("path"),
    )


def audit(proven: DataFrame, now: str, path: str = "path", root: str = "root") -> DataFrame:
    """Add ``proof_sha256``, ``folded_root``, what a leaf ``now`` makes of the root by its old path, and ``verified``."""
    beside = joined(F.transform(path, lambda p: F.concat(p["l"], p["r"])))
    folded = F.aggregate(path, F.col(now), lambda a, p: digest(F.concat(p["l"], a, p["r"])))
    rows = proven.select("*", digest(beside).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.select("*", (F.col("folded_root") == F.col(root)).alias("verified"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN (~list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384)))) & 1 = 0
      THEN replace(text, chr(10), '') ELSE text END AS bare
  FROM documents),
e AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
leaves AS (
  SELECT doc_id, source, i, n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS now FROM e),
lv AS (
  SELECT source, 0 AS k, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY source, k, n, i // 3),
subs AS (SELECT source, h AS subroot, k AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (
  SELECT 0 AS k, i, n, subroot AS h FROM subs
  UNION ALL
  SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE n > 1 GROUP BY k, n, i // 3),
kin AS (
  SELECT l.doc_id, v.k AS step, coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i < l.i // (3 ** v.k)::BIGINT), '') AS lhs,
    coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i > l.i // (3 ** v.k)::BIGINT), '') AS rhs
  FROM leaves l JOIN lv v ON v.source IS NOT DISTINCT FROM l.source AND v.n > 1 AND v.i // 3 = l.i // (3 ** (v.k + 1))::BIGINT GROUP BY l.doc_id, v.k
  UNION ALL
  SELECT l.doc_id, s.depth + v.k, coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i < s.i // (3 ** v.k)::BIGINT), ''),
    coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i > s.i // (3 ** v.k)::BIGINT), '')
  FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN tv v ON v.n > 1 AND v.i // 3 = s.i // (3 ** (v.k + 1))::BIGINT
  GROUP BY l.doc_id, s.depth, v.k),
proof AS (SELECT doc_id, string_agg(lhs || rhs, '' ORDER BY step) AS p, count(*) AS steps FROM kin GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0::BIGINT AS step, now AS h FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(k.lhs || f.h || k.rhs) FROM fold f JOIN kin k ON k.doc_id = f.doc_id AND k.step = f.step)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN tv t ON t.n = 1
LEFT JOIN proof p ON p.doc_id = l.doc_id JOIN fold f ON f.doc_id = l.doc_id AND f.step = coalesce(p.steps, 0)
"""
