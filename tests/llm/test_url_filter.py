import random
import re

import pytest

from docspark.llm.queries import URL_RULES
from docspark.llm.url_filter import address, declared_links, judge_pages, rule_table
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, key string, rule string, verdict string, root string, target string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "r", "v", "x", "t") for r in rows], SCHEMA)


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return (lower(found[1]), found[2]) if found else ("", "")


def plain_rule(url):
    host, path = parts(url)
    fit = [
        (len(rule), verdict, rule)
        for rule, verdict in URL_RULES
        for end, under in [(rule.split("/")[0], rule[rule.index("/") :])]
        if (host == end or host.endswith("." + end)) and path.startswith(under)
    ]
    return max(fit)[1:] if fit else (None, None)


def plain(rows, links, same=lambda url: url):
    """Classes by flooding; ``same`` is what an address stands for."""
    urls = {r[1] for r in rows if r[1] is not None} | {u for pair in links for u in pair}
    near = {u: set() for u in urls}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for u in urls:
        for v in urls:
            if same(u) == same(v):
                near[u].add(v)
    out = []
    for page_id, url, *_ in rows:
        verdict, rule = plain_rule(url)
        if verdict is None:
            seen, todo = {url}, [url]
            while todo:
                for v in near.get(todo.pop(), ()):
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            decided = {plain_rule(u)[0] for u in seen}
            verdict = "block" if "block" in decided and "allow" not in decided else "allow"
        out.append((page_id, *parts(url), rule, verdict))
    return sorted(out, key=str)


def check(spark, rows, links=(), redirects=None, same=lambda url: url):
    got = judge_pages(pages(spark, rows), rule_table(spark, URL_RULES), redirects)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, list(links), same)


def test_odd_rows(spark):
    rows = [
        (1, None, None), (1, None, None), (None, "", ""), (2, "no scheme", "x"), (3, "http://", None), (4, "http://EXAMPLE.org", ""),
        (5, "HTTP://a.Example.ORG/es/x?y#z", None), (6, "http://example.org/en/12", None), (7, "http://example.org/en/2", None),
        (8, "http://notexample.org/es/", None), (9, "x://com/de/", None), (10, "x://com/fr/://org/", None), (11, "http://É.com/de/", None),
        (12, "http://a.net/" + "d/" * 5000, None), (13, "http://" + "a." * 5000 + "com/de/", None), (14, "http://a.com/de/\nx", None),
        (15, "http://a.com/de/\nx", None), (16, "http://o.org?x", None), (17, "http://com", None),
    ]
    check(spark, rows)
    assert judge_pages(pages(spark, []), rule_table(spark, URL_RULES)).count() == 0
    none = judge_pages(pages(spark, rows), rule_table(spark, URL_RULES).limit(0))
    assert {tuple(r) for r in none.select("rule", "verdict").collect()} == {(None, "allow")}


def test_blocks_reach_aliases_and_allows_come_first(spark):
    bad, good, free = "http://a.com/de/1", "http://b.com/fr/1", "http://c.net/1"
    link = lambda target: f'<html><head><LINK href="{target}" REL=canonical></head>'
    refresh = lambda target: f"<meta content='0; URL={target}' http-equiv='refresh'>"
    rows = [
        (1, bad, ""), (2, free, link(bad)), (3, "http://d.net/1", refresh(free)), (4, "http://e.net/", link("http://f.net/2")), (5, "http://f.net/2", ""),
        (6, "http://g.net/1", link("/2")), (7, "http://g.net/2", refresh("http://h.com/de/x")), (8, "http://i.net/", link("//a.com/de/9")),
        (9, good, link("http://k.net/1")), (10, "http://k.net/1", link("http://l.com/de/2")), (11, "http://l.com/de/2", ""),
        (12, "http://m.net/a/b", link("c")), (13, "http://m.net/a/c", link("http://x.example.org/es/q")),
        (14, "http://n.net/", "<!-- " + link(bad) + " -->"), (15, "http://o.net/", "<script>'" + link(bad) + "'</script>"), (16, "http://p.net/", link("javascript:void(0)")),
        (17, "http://q.net/", f'<link rel="alternate" href="{bad}">'), (18, good, link("http://k.net/1")),
    ]
    links = [
        (free, bad), ("http://d.net/1", free), ("http://e.net/", "http://f.net/2"), ("http://g.net/1", "http://g.net/2"), ("http://g.net/2", "http://h.com/de/x"),
        ("http://i.net/", "http://a.com/de/9"), (good, "http://k.net/1"), ("http://k.net/1", "http://l.com/de/2"), ("http://m.net/a/b", "http://m.net/a/c"),
        ("http://m.net/a/c", "http://x.example.org/es/q"),
    ]
    found = declared_links(pages(spark, rows)).distinct().collect()
    assert sorted(map(tuple, found)) == sorted(links)
    check(spark, rows, links)
    got = {r.page_id: r.verdict for r in judge_pages(pages(spark, rows), rule_table(spark, URL_RULES)).collect()}
    assert [got[i] for i in (2, 3, 6, 8, 12, 13)] == ["block"] * 6
    assert [got[i] for i in (4, 10, 14, 15, 16, 17)] == ["allow"] * 6 and got[11] == "block"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_redirects(spark, seed):
    """A hub that a third of all URLs redirect to, chains, cycles and stray pairs."""
    rng = random.Random(seed)
    urls = [f"http://h{i}.{rng.choice(['net', 'net', 'net', 'com/de', 'com/fr', 'example.org/es'])}/{i}" for i in range(150)]
    links = [(u, urls[0]) for u in urls[1::3]] if seed == 1 else []
    links += [(urls[i], urls[i + 1]) for i in range(40, 70)] + [tuple(rng.sample(urls, 2)) for _ in range(30)]
    rows = [(i, rng.choice(urls), None) for i in range(300)] + [(1000 + i, u, None) for i, u in enumerate(urls)]
    check(spark, rows, links, spark.createDataFrame(links, "url string, target string"))


def test_addresses(spark):
    groups = [
        ["http://www.a.net/x", "https://a.net:443/x#y", "HTTP://A.net/x?utm_source=q&ref=z", "http://a.net:80/x?"],
        ["http://a.net", "https://www.a.net/", "http://a.net/?fbclid=1"],
        ["http://a.net/x?b=1&ref=2"], ["http://m.a.net/x"], ["http://a.net/x?reference=1"], ["mailto:x"], [""],
    ]
    flat = [(i, u) for i, group in enumerate(groups) for u in group]
    got = spark.createDataFrame(flat, "i int, url string").select("i", address(F.col("url")).alias("a")).collect()
    names = {}
    for r in got:
        names.setdefault(r.i, set()).add(r.a)
    assert [len(names[i]) for i in range(5)] == [1] * 5
    assert len(set.union(*names.values())) == len(groups)
