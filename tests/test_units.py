import os
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.sources.files import extract_trans_units, label_names, scan_labelled_files
from docspark.sources.nesting import first_nested, paired
from docspark.sources.units import scan_trans_units, scan_units


@pytest.fixture()
def small_splits(spark):
    """Splits of a few bytes, so that pieces, comments and marks lie across them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def unit(i, text, alternative=True, inner=""):
    return f'<trans-unit id="{i}">{inner}<source>{text}</source>{"<alt-trans/>" if alternative else ""}</trans-unit>\n'


def random_file(rng):
    parts = ["﻿" * rng.randrange(2) + "<?xml version='1.0'?><xliff><body>\n"]
    for i in range(rng.randrange(40)):
        kind = rng.randrange(10)
        text = " ".join(rng.choice(["the", "žluť", "a &lt; b", "<g id='1'>x</g>", "-->", "\n"]) for _ in range(rng.randrange(12)))
        if kind == 0:
            parts.append("<!-- hidden " + "".join(unit(f"{i}.{k}", "no") for k in range(rng.randrange(4))) + " -->")
        elif kind == 1:
            parts.append(unit(i, text, inner=f"<!-- x {unit('c', 'no')} y {unit('d', 'no')} -->"))
        elif kind == 2:
            parts.append(unit(i, f"<![CDATA[a < <b> &amp; <!-- {i}]]>" + text))
        elif kind == 3:
            parts.append("junk <note>between</note>" * rng.randrange(9))
        else:
            parts.append(unit(i, text, kind > 5))
    return "".join(parts) + rng.choice(["</body></xliff>", "", "\n", "<!-- never closed"])


def test_splits_give_what_one_row_gives(spark, small_splits, tmp_path):
    rng = random.Random(4)
    for i in range(12):
        (tmp_path / f"#category#legal{i}#.xlf").write_text(random_file(rng), encoding="utf-8")
    (tmp_path / "other.xlf").write_text(unit(1, "not labelled"))
    (tmp_path / "#category#empty#.xlf").write_text("")
    whole = extract_trans_units(scan_labelled_files(spark, str(tmp_path)), "content", "name").collect()
    found = scan_trans_units(spark, str(tmp_path), glob="*#category#*")
    assert found.select("path").distinct().count() > 5
    name = F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name")
    got = found.select(name, "pos", "segment").collect()
    assert len({(r.name, r.pos) for r in got}) == len(got)
    order = lambda rows: [(r.name, r.segment) for r in sorted(rows, key=lambda r: (r.name, r.pos))]
    assert len(got) > 80 and order(got) == order(whole)


def test_one_file_is_many_tasks(spark, small_splits, tmp_path):
    (tmp_path / "a.xlf").write_text("".join(unit(i, f"text {i}") for i in range(200)))
    units = scan_units(spark, str(tmp_path))
    assert units.rdd.getNumPartitions() > 50
    assert "Exchange" not in units._jdf.queryExecution().executedPlan().toString()
    rows = sorted(units.collect(), key=lambda r: r.pos)
    assert [re.search(r'id="(\d+)"', r.unit)[1] for r in rows] == [str(i) for i in range(200)]


def test_other_closing_tags_bad_bytes_and_unclosed_units(spark, tmp_path):
    (tmp_path / "a.xlf").write_bytes(b"<x:trans-unit><x:source>\xff ok</x:source></x:trans-unit><x:trans-unit>open <x:source>to the end")
    got = [r.unit for r in scan_units(spark, str(tmp_path), "</x:trans-unit>").orderBy("pos").collect()]
    assert got == ["<x:trans-unit><x:source>� ok</x:source></x:trans-unit>", "<x:trans-unit>open <x:source>to the end</x:trans-unit>"]


def test_labels_from_folders(spark, tmp_path):
    rows = [("#category#legal#targetid#7#", unit(1, "one")), ("#category#tourism#", unit(2, "two"))]
    spark.createDataFrame(rows, "file string, value string").write.partitionBy("file").text(str(tmp_path / "x"))
    found = label_names(scan_trans_units(spark, str(tmp_path / "x")), "file").select("category", "target_id", "segment")
    assert sorted(map(tuple, found.collect())) == [("legal", "7", "one"), ("tourism", "unknown", "two")]


# ---- nesting --------------------------------------------------------------------------------------

TOKEN = re.compile(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|</?[A-Za-z][^<>]*>|[^<]+|<")


def plain_nested(content, names=("trans-unit", "source", "alt-trans")):
    """One pass with a stack per name: closing tags close the nearest of their name."""
    tokens = TOKEN.findall(content)
    stacks, elements = {n: [] for n in names}, []
    for at, token in enumerate(tokens):
        tag = re.match(r"</?(?:[\w.-]+:)?([A-Za-z][\w.-]*)", token)
        name = tag and tag[1].lower()
        if name not in stacks:
            continue
        if token.startswith("</"):
            if stacks[name]:
                stacks[name].pop()[2] = at
        else:
            element = [name, at, at if token.endswith("/>") else len(tokens)]
            elements.append(element)
            if not token.endswith("/>"):
                stacks[name].append(element)
    out = []
    chosen = {}
    for name, start, end in elements:
        if name == "trans-unit":
            inner = [e for e in elements if start < e[1] < end]
            child = next((e for e in inner if e[0] == "source"), None)
            if any(e[0] == "alt-trans" for e in inner):
                out.append((2 * start, child and child[1]))
                if child:
                    chosen[child[1]] = max(chosen.get(child[1], 0), min(child[2], end))
    texts = {}
    for at, token in enumerate(tokens):
        start = max((s for s in chosen if s < at), default=None)
        if start is not None and at < chosen[start]:
            if token.startswith("<![CDATA["):
                token = token[9:-3]
            elif token.startswith("<!--") or re.match(r"</?[A-Za-z]", token):
                continue
            texts[start] = texts.get(start, "") + token
    return [(place, None if start is None else texts.get(start, "")) for place, start in out]


def test_nested_and_unclosed_units(spark):
    rng = random.Random(8)
    pieces = ["<trans-unit>", "</trans-unit>", "<x:Source a='1'>", "</x:Source>", "<source/>", "<alt-trans>", "</alt-trans>", "<alt-trans/>", "text ", "<g>", "</g>"]
    pieces += ["<!-- <source> -->", "<![CDATA[<source>&]]>", "< ", "<trans-unit/>"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(300)] + [(300, None), (301, "")]
    found = first_nested(spark.createDataFrame(rows, "path long, content string"), "content", "path").collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.path, r.place)):
        got.setdefault(r.path, []).append((r.place, r.text))
    assert got == {i: want for i, content in rows if content for want in [plain_nested(content)] if want}


def test_the_first_source_follows_the_tree(spark):
    content = (
        "<trans-unit id='1'><group><trans-unit id='2'><source>inner</source><alt-trans/></trans-unit></group><source>outer</source></trans-unit>"
        "<trans-unit id='3'><alt-trans><source>wrong</source></alt-trans></trans-unit><trans-unit id='4'><alt-trans/></trans-unit><source>none's</source>"
    )
    rows = first_nested(spark.createDataFrame([("f", content)], "path string, content string"), "content", "path").orderBy("place").collect()
    assert [(r.depth, r.text) for r in rows] == [(1, "inner"), (2, "inner"), (1, "wrong"), (1, None)]


def test_strays_close_nothing(spark):
    events = spark.createDataFrame([(1, "a", p, s) for p, s in enumerate([-1, 1, 1, -1, -1, -1, 1, -1, 1])], "k int, name string, place long, step int")
    assert sorted((r.start, r.end, r.depth) for r in paired(events, "k").collect()) == [(1, 4, 1), (2, 3, 2), (6, 7, 1), (8, None, 1)]
