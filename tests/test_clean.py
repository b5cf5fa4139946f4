import html
import itertools
import random

from docspark.functions.clean import clean_text, decode_entities, strip_markup
from pyspark.sql import functions as F


def apply(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [row.o for row in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


CASES = {
    "a\nb": "ab",
    "a \t b": "a b",
    "\u00a0x\u2003\u00a0y": "x y",
    "x\u0085\u0085y": "x y",
    "\u3000 z": "z",
    "\x1c\x1cq\x1c": "q",
    "k\\r\\nl": "kl",
    "<a\rb>c": "c",
    "<a\nb>c": "<ab>c",
    "\u00e9<b>\u00e8</b>": "",
    "\u2003 ": "",
    "\u200bx": "x",
    "\U0001f600 a  b": " a b",
    "1 < 2 > 3": "1  3",
}


def test_written_cases(spark):
    assert apply(spark, list(CASES), clean_text) == list(CASES.values())


def plain(text):
    """What is left of a text without tags: printable ASCII, and one space for white space of two or more."""
    runs = [(space, "".join(run)) for space, run in itertools.groupby(text, str.isspace)]
    inner = [" " if space and len(run) > 1 else run for space, run in runs]
    if runs and runs[0][0]:
        inner[0] = ""
    if runs and runs[-1][0]:
        inner[-1] = ""
    return "".join(c for c in "".join(inner) if 32 <= ord(c) < 127)


def test_random_unicode(spark):
    rng = random.Random(5)
    letters = "ab \t\n\r\x0b\x0c\x1c\x1d\x1f\x7f\x85\xa0\u2003\u3000\u00e9\u00df\u6f22\U0001f600\u200b\ufeff"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    assert apply(spark, texts, clean_text) == [plain(text) for text in texts]


def test_modes_differ_on_single_white_space(spark):
    assert apply(spark, ["a\nb", "a b"], clean_text) == ["ab", "ab"]
    assert apply(spark, ["a\nb", "a b"], lambda t: clean_text(t, "safe")) == ["a b", "a b"]


def test_entities_are_decoded_once(spark):
    texts = ["&amp;lt;b&amp;gt;", "&lt;&#233;&#x41;&eacute;&unknown; &amp", "a & b", "&middot;&copy;&nbsp;|", None, "&amp;amp;#65;"]
    assert apply(spark, texts, decode_entities) == [text and html.unescape(text) for text in texts]
    assert apply(spark, ["&eacute;&amp;"], lambda t: decode_entities(t, "common")) == ["&eacute;&"]


def test_markup(spark):
    texts = [
        "<p>a<br/>b</p><!-- x <p>y</p> -->c",
        "<script>var a = '<p>';</script>x<STYLE type='t'>p{}</STYLE>y",
        "2 < 3 and 4 > 1 <b>&lt;i&gt;</b>",
    ]
    assert apply(spark, texts, strip_markup) == ["abc", "xy", "2 < 3 and 4 > 1 <i>"]
