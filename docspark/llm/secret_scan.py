"""Secret scan with multipart linking: weak parts count only beside the parts that complete them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import KEY as ROW
from docspark.llm.common import keyed, matched
from docspark.session import materialize

# The base patterns, in the order of their kinds.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: The value at the end of an assignment; the separator before it is no letter of a value or is '='.
ASSIGN_VALUE = "^[A-Za-z_]+[\"']?\\x20*[:=]\\x20*[\"']?(.*)$"

#: Code points between two parts that still belong to one credential.
REACH = 200

# Weak kinds: an account name, a key-like value under a weak name, an address.
ACCOUNT = "(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_id|[Kk]ey_id)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}"
KEY = "(?:[Pp]wd|[Pp]ass|[Aa]uth|[Kk]ey|[Cc]redential|[Bb]earer)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}"
ENDPOINT = "[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9@:%._-]+"
BREAK = "\\n[\\x20\\x09\\x0D]*\\n"

#: kind -> (order in a tie, role, pattern, shortest match)
KINDS = {
    "assign": (0, "secret", ASSIGN, 0),
    "access": (1, "name", ACCESS, 16),
    "hex": (2, "secret", "[0-9a-f]{32,}", 32),
    "account": (3, "name", ACCOUNT, 0),
    "key": (4, "secret", KEY, 0),
    "endpoint": (5, "endpoint", ENDPOINT, 0),
    "break": (6, "break", BREAK, 0),
}
BASE = ("assign", "access", "hex")
#: What completes a weak part.
COMPLETES = (("name", "secret"), ("secret", "name"), ("secret", "endpoint"), ("endpoint", "secret"))


def found_parts(rows: DataFrame) -> DataFrame:
    """Every match of every kind with its place: ``doc_id, text_key, kind, role, start, end``.

    A pattern's matches and the gaps between them alternate, so places are running sums of lengths.
    Only texts with a part that may link or a base match are taken apart, and a pattern runs again
    only over texts in which it was seen once.
    """

    def taken(kind: str) -> Column:
        pattern = KINDS[kind][2]
        hits = F.concat(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        both = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), hits.alias("hit"))
        return F.when(F.col(f"has_{kind}"), F.struct(F.lit(kind).alias("kind"), both.alias("pieces")))

    seen = rows.select("*", *[F.col("text").rlike(KINDS[k][2]).alias(f"has_{k}") for k in KINDS if k != "break"])
    some = seen.where(" OR ".join(f"has_{k}" for k in KINDS if k != "break")).withColumn("has_break", F.col("text").rlike(BREAK))
    kinds = some.select("doc_id", "text_key", F.explode(F.array_compact(F.array(*map(taken, KINDS)))).alias("k"))
    pieces = kinds.select("doc_id", "text_key", "k.kind", F.posexplode("k.pieces").alias("n", "p")).select(
        "doc_id", "text_key", "kind", "n", F.char_length("p.gap").cast("long").alias("gap"), F.char_length("p.hit").cast("long").alias("length"), F.col("p.hit").alias("hit")
    )
    own = W.partitionBy("doc_id", "text_key", "kind").orderBy("n")
    placed = pieces.dropDuplicates(["doc_id", "text_key", "kind", "n"]).withColumn("end", F.sum(F.col("gap") + F.col("length")).over(own))
    long_enough = F.when(F.col("kind") == "assign", F.char_length(F.regexp_extract("hit", ASSIGN_VALUE, 1)) >= 8).otherwise(
        F.col("length") >= F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[3])]), F.col("kind"))
    )
    role = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])]), F.col("kind"))
    return placed.where((F.col("length") > 0) & long_enough).select(
        "doc_id", "text_key", "kind", role.alias("role"), (F.col("end") - F.col("length")).alias("start"), "end"
    )


def scoped(parts: DataFrame) -> DataFrame:
    """Number the scopes (blocks between blank lines) of each text and drop the breaks themselves."""
    before = W.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    return parts.withColumn("scope", F.count(F.when(F.col("role") == "break", 1)).over(before)).where("role <> 'break'")


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts with a complementary part in their scope at most ``reach`` code points away.

    An interval join over bins of ``reach`` code points: per bin and role only the first start and
    the last end are kept, which decide every case, because the interval asked for is longer than a
    bin. So a candidate meets a few rows however many parts its document has, and no pair is listed.
    """
    spread = F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)))
    bins = parts.withColumn("bin", spread).groupBy("doc_id", "text_key", "scope", "role", "bin").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    pairs = F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("other")) for a, b in COMPLETES])
    weak = parts.where(~F.col("kind").isin(*BASE)).withColumn("need", F.explode(F.transform(F.filter(pairs, lambda p: p["role"] == F.col("role")), lambda p: p["other"])))
    asked = weak.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - reach - 1) / reach), F.floor((F.col("end") + reach) / reach))))
    near = f"low <= end + {reach} AND high >= start - {reach}"
    bins = bins.withColumnRenamed("role", "need")
    return matched(asked, bins, [*ROW, "scope", "bin", "need"], "left_semi", near).select(*ROW, "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Secrets of every whole text: base kinds always, weak kinds beside what completes them.

    Returns per input row ``doc_id`` and ``found``, an array of ``(start, rank, kind, end)`` in order
    of start and kind; places are code points, ends exclusive. A null text is empty and has no
    spans; rows that agree in id and text get one result each. Empty tables give no rows; other
    columns are not read. Documents of any length and number of spans are one sorted group.
    """
    rows = keyed(docs, id_col, text_col)
    parts = materialize(found_parts(rows), "secret-parts")
    linked = linked_parts(scoped(parts), reach)
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])]), F.col("kind"))
    spans = parts.where(F.col("kind").isin(*BASE)).select("doc_id", "text_key", "kind", "start", "end").unionByName(linked)
    per_text = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    keys = rows.select("doc_id", "text_key")
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return matched(keys, per_text, ROW, "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def span_report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan_secrets``: counts per base kind, digest of the base spans, all spans."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written("found").alias("spans"))


def _sql() -> str:
    cases = []
    for kind, (rank, role, pattern, _) in KINDS.items():
        quoted = pattern.replace("'", "''")
        cases.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, '{role}' AS role, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS hits FROM d WHERE regexp_matches(text, '{quoted}')"
        )
    value = ASSIGN_VALUE.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(cases)}),
p AS (SELECT doc_id, kind, rank, role, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM m),
q AS (SELECT doc_id, kind, rank, role, hits[i] AS hit, length(hits[i]) AS n,
        sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM p),
f AS (SELECT doc_id, kind, rank, role, e - n AS s, e FROM q
      WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{value}', 1)) >= 8 WHEN 'access' THEN n >= 16 ELSE TRUE END),
o AS (SELECT *, count(CASE WHEN role = 'break' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS scope FROM f),
c(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in COMPLETES)}),
k AS (SELECT doc_id, kind, rank, s, e FROM f WHERE rank < 3 UNION ALL
      SELECT doc_id, kind, rank, s, e FROM o WHERE rank > 2 AND role <> 'break' AND EXISTS (
        SELECT 1 FROM o z JOIN c ON c.b = z.role WHERE c.a = o.role AND z.doc_id = o.doc_id AND z.scope = o.scope AND z.s <= o.e + {REACH} AND z.e >= o.s - {REACH})),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
