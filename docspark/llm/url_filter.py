"""URL rules whose blocks reach the aliases of a page: components over redirect and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.minhash import components
from docspark.session import materialize

#: Host and path of a URL; the scheme ends at the first ``://``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query parameters that tell where a visitor came from, not which page is meant.
TRACKING = r"(?s)^(?:utm_[^=]*|ref|fbclid|gclid)(?:=.*)?$"
NO_PAGE = r"(?s)<!--.*?-->|(?i)<script\b.*?</script>"
CANONICAL = r"""(?is)^<link\b[^>]*?\srel\s*=\s*["']?\s*canonical(?=["'\s/>])"""
REFRESH = r"""(?is)^<meta\b[^>]*?\shttp-equiv\s*=\s*["']?\s*refresh(?=["'\s/>])"""
HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
GOAL = r"""(?is)\scontent\s*=\s*["'][^"'>]*?url\s*=\s*["']?\s*([^"'>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """The page that a server would answer with: no scheme, ``www.``, default port, fragment or tracking parameters."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r":(?:80|443)?$", ""), r"^www\.(?=.)", "")
    query = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING)), "&")
    place = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(bare == "", url).otherwise(F.concat(bare, place, F.lit("?"), kept))


def resolved(link: Column, url: Column) -> Column:
    """An address as a page states it, seen from the page's own; null for what is no address of a page."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^?#]*/)", 1)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(r"(?i)^https?://."), link)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(site == "", None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder != "", F.concat(folder, link))
        .otherwise(F.concat(site, F.lit("/"), link))
    )


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url, target``: canonical addresses and refresh redirects that pages name, outside comments and scripts."""
    rows = pages.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace("html", NO_PAGE, ""), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    named = rows.select("url", F.explode(tags).alias("tag"))
    href = F.concat(*[F.coalesce(F.regexp_extract("tag", HREF, k), F.lit("")) for k in (1, 2, 3)])
    goal = F.when(F.col("tag").rlike(CANONICAL), href).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", GOAL, 1))
    return named.select("url", resolved(goal, F.col("url")).alias("target")).where("target IS NOT NULL")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` of distinct ``url``: the longest rule whose host ends the URL's and whose path starts its path.

    Hosts meet rules by an equi-join on their endings, of which no more are listed than the longest rule
    host has labels. Of equally long rules an allowing one counts, then the first.
    """
    known = rules.select("rule", F.lower("verdict").alias("verdict"), lower_ascii(F.regexp_extract("rule", r"(?s)^([^/]*)", 1)).alias("end"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("under"))
    most = known.agg(F.max(F.size(F.split("end", r"\.")))).first()[0] or 1
    labels = F.split(host(F.col("url")), r"\.")
    rows = urls.select("url", path(F.col("url")).alias("path"), F.slice(labels, -F.least(F.size(labels), F.lit(most)), most).alias("labels"))
    ends = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, most), "."))
    met = rows.select("url", "path", F.explode(ends).alias("end")).join(known, "end").where(F.startswith("path", "under"))
    best = met.groupBy("url").agg(F.max(F.struct(F.char_length("rule").alias("n"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict")).alias("best"))
    return urls.join(best, "url", "left").select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Allow or block every page by rules on its URL, and by those on its aliases.

    Aliases are URLs in one connected component of these links: canonical and refresh links that pages
    name in ``html_col``, pairs ``url, target`` of ``redirects``, and URLs that only differ in scheme, ``www.``,
    default port, fragment or tracking parameters. A URL's own rule decides it. Without one, it is
    blocked if an alias has a blocking rule, unless another alias has an allowing one, which takes
    precedence; else it is allowed. Targets count as aliases whether they are pages or not.

    URLs are taken once and known by SHA-256 in the component rounds; those of one address are hung below
    its least, so that a much copied address is an aggregate and not a hub. Pages meet the
    decisions by an equi-join on that key, whose hot keys the engine splits.

    Returns ``page_id, host, path, rule, verdict`` per input row; ``rule`` is the longest fitting one or null.
    A null URL, or one without ``://``, has empty host and path and no alias but links that name it.
    Repeated rows and null ids give a row each; an empty table gives none, an empty rule table allows all;
    other columns are not read.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(f"`{url_col}`").cast("string").alias("url"))
    links = spark.createDataFrame([], "url string, target string")
    if html_col is not None:
        links = declared_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").cast("string"), F.col("target").cast("string")))
    links = materialize(links.where("url IS NOT NULL AND target IS NOT NULL").distinct(), "links")
    every = own.unionByName(links.select("url")).unionByName(links.select(F.col("target").alias("url"))).where("url IS NOT NULL").distinct()
    key = F.unhex(F.sha2("url", 256))
    known = materialize(ruled(every, rules).select(key.alias("key"), F.unhex(F.sha2(address(F.col("url")), 256)).alias("address"), "rule", "verdict"), "urls")
    heads = known.groupBy("address").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1")
    same = known.join(heads, "address").select(F.col("key").alias("a"), F.col("head").alias("b"))
    named = links.select(F.unhex(F.sha2("url", 256)).alias("a"), F.unhex(F.sha2("target", 256)).alias("b"))
    roots = components(same.unionByName(named))
    member = known.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "rule", "verdict", F.coalesce("root", "key").alias("root"))
    member = materialize(member, "members")
    has = lambda verdict: F.max(F.col("verdict").eqNullSafe(F.lit(verdict)))
    blocked = member.groupBy("root").agg(has("block").alias("block"), has("allow").alias("allow")).where("block AND NOT allow").select("root", "block")
    judged = member.join(blocked, "root", "left").select(
        "key", "rule", F.coalesce("verdict", F.when(F.col("block"), "block"), F.lit("allow")).alias("verdict")
    )
    judged = materialize(judged.where("rule IS NOT NULL OR verdict = 'block'"), "judged")
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(url).alias("host"), path(url).alias("path"), F.unhex(F.sha2(url, 256)).alias("key"))
    return rows.join(judged, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(rule, verdict, h, s) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
    ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
said AS (
  SELECT url, regexp_extract(tag, '(?i)(?:href\s*=\s*|url\s*=\s*)["'']?\s*(https?://[^"''\s>]+)', 1) AS target FROM tags JOIN p USING (page_id)
  WHERE regexp_matches(tag, '(?i)\srel\s*=\s*["'']?\s*canonical|\shttp-equiv\s*=\s*["'']?\s*refresh')),
nodes AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$')), '&') AS query
  FROM (SELECT url FROM p UNION SELECT target FROM said) WHERE url <> ''),
named AS (
  SELECT url, CASE WHEN host = '' THEN url ELSE regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\.', '') || CASE WHEN path = '' THEN '/' ELSE path END || '?' || query END AS address,
    (SELECT max(struct_pack(n := length(rule), r := rule, v := verdict)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS best
  FROM nodes),
links AS (
  SELECT url AS a, min(url) OVER (PARTITION BY address) AS b FROM named UNION SELECT url, target FROM said WHERE target <> ''),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
judged AS (
  SELECT r.a AS url, bool_or(coalesce(n.best.v = 'block', false)) AND NOT bool_or(coalesce(n.best.v = 'allow', false)) AS bad
  FROM reach r JOIN named n ON n.url = r.b GROUP BY r.a)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN named USING (url) LEFT JOIN judged USING (url)
"""
