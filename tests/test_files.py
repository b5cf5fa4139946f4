import os

import pytest

from docspark.models.language import fit_language_model
from docspark.plans.extraction import extract_documents
from docspark.sources.files import extract_trans_units, label_names, scan_labelled_files
from docspark.streaming.ingest import ingest_files
from pyspark.sql import functions as F

BASIC = """<?xml version="1.0"?><xliff xmlns="urn:oasis:names:tc:xliff:document:1.2"><file><body>
<trans-unit id="1"><source>The <g id="1">red</g> house &amp;amp; garden</source><target>x</target>
<alt-trans><source>wrong</source></alt-trans></trans-unit>
<trans-unit id="2"><source>no alternative here</source></trans-unit>
<trans-unit id="3"><source>&lt;b&gt;the old mill&lt;/b&gt; by the river</source><alt-trans/></trans-unit>
</body></file></xliff>"""

ODD = """<x:trans-unit id="1"><x:source>prefixed &nbsp; one</x:source><x:alt-trans> </x:alt-trans></x:trans-unit>
<trans-unit id="2"><source/><alt-trans><source>inner</source></alt-trans></trans-unit>
<trans-unit id="3"><source><![CDATA[a < b &amp; <i>c</i>]]> d<br></source><alt-trans/></trans-unit>
<trans-unit id="4"><source-ref>no</source-ref><source xml:lang="en">yes &#65;</source><alt-trans/></trans-unit>
<!-- <trans-unit id="5"><source>hidden</source><alt-trans/></trans-unit> -->
<trans-unit id="6"><source>never closed<alt-trans/></trans-unit>"""


def write(folder, name, content, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "wb") as file:
        file.write(content if isinstance(content, bytes) else content.encode(encoding))


def units(spark, content):
    df = spark.createDataFrame([("f", content)], "path string, content string")
    return [row.segment for row in extract_trans_units(df, "content", "path").orderBy("pos").collect()]


def test_units_with_alternative_in_order(spark):
    assert units(spark, BASIC) == ["The red house &amp; garden", "<b>the old mill</b> by the river"]


def test_odd_markup_never_fails(spark):
    assert units(spark, ODD) == ["prefixed   one", "", "a < b &amp; <i>c</i> d", "yes A", ""]


def test_a_very_long_unit(spark):
    text = "word <g id='1'>x</g> and more " * 40_000
    unit = f"<trans-unit id='1'><source>{text}<![CDATA[{text}]]></source><alt-trans/></trans-unit>"
    plain = "word x and more " * 40_000
    assert units(spark, unit * 2) == [plain + text] * 2


def test_labels_of_names(spark):
    names = [
        "#category#legal#subcategory#tax#targetid#0012#.xlf",
        "#subcategory#tax##category#medicaldevices#.xlf",
        "#category#lifesciences-PFA#targetid#x.xlf",
        "#subcategory#tax#.xlf",
        "#category##.xlf",
    ]
    df = spark.createDataFrame([(name,) for name in names], "name string")
    rows = {row.name: row[1:] for row in label_names(df).collect()}
    assert rows == {
        names[0]: ("legal", "tax", "0012"),
        names[1]: ("medicaldevice", "tax", "unknown"),
        names[2]: ("lspfa", "unknown", "unknown"),
    }


def test_scan_takes_labelled_files_only(spark, tmp_path):
    write(tmp_path, "#category#legal#a b%23.xlf", "x")
    write(tmp_path, "other.xlf", "x")
    os.mkdir(tmp_path / "#category#legal#folder")
    write(tmp_path, "#category#utf16#.xlf", "é<source>", "utf-16")
    write(tmp_path, "#category#bad#.xlf", b"ok \xff\xfe\x80 ok")
    rows = {row.name: row.content for row in scan_labelled_files(spark, str(tmp_path)).collect()}
    assert rows == {
        "#category#legal#a b%23.xlf": "x",
        "#category#utf16#.xlf": "é<source>",
        "#category#bad#.xlf": "ok ��� ok",
    }


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the old house by the river and the red garden", "en"), ("das alte haus am fluss und der rote garten", "de")]
    return fit_language_model(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")


@pytest.fixture()
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "#category#legal#targetid#007#.xlf", BASIC)
    german = BASIC.replace('The <g id="1">red</g> house &amp;amp; garden', "das rote haus")
    german = german.replace("the old mill&lt;/b&gt; by the river", "am fluss")
    write(source, "#category#tourism#.xlf", german)
    write(source, "unlabelled.xlf", BASIC)
    return source


def test_extraction_end_to_end(spark, folder, model):
    rows = [row[1:] for row in extract_documents(spark, str(folder), model, "en").collect()]
    assert rows == [("The red house & garden the old mill by the river", "legal", "unknown", "007")]


def test_new_files_are_ingested_once(spark, folder, model, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        ingest_files(spark, str(folder), target, checkpoint, model, "en").awaitTermination()
        return spark.read.parquet(target).select("categories").orderBy("categories").collect()

    assert [row[0] for row in run()] == ["legal"]
    write(folder, "#category#banking#.xlf", BASIC)
    assert [row[0] for row in run()] == ["banking", "legal"]
    assert [row[0] for row in run()] == ["banking", "legal"]
