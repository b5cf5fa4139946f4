import random

import regex
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from docspark.functions.tokens import ENGLISH_STOP_WORDS, NON_WORD, _normal, as_text, filter_tokens, first_words, sentences, words


def restated(text, limit=50, stops=ENGLISH_STOP_WORDS):
    kept = []
    for token in regex.split(r"[^\p{L}\p{N}]+", (text or "")[:1_000_000]):
        if len(kept) == limit:
            break
        if token.lower() in stops:
            continue
        if regex.fullmatch(r"\p{Nd}+", token):
            kept.append("NUM")
        elif regex.fullmatch(r"\p{L}+", token):
            kept.append(token.lower())
    return kept


def apply(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [row.o for row in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


def test_stop_list_is_sparks(spark):
    assert sorted(ENGLISH_STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_filter_order_and_cap(spark):
    rng = random.Random(3)
    vocabulary = "the The of and a x1 42 007 ² Ü über Cat dog it's 2nd ½ naïve 漢字".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice((0, 3, 49, 50, 60, 199, 200, 201, 400)))) for _ in range(300)]
    texts += [None, "", "...", "the " * 500 + "cat " * 70, " leading", "trailing ", "the " * 199 + "cat", "cat " * 50 + "dog"]
    assert apply(spark, texts, lambda t: filter_tokens(t, max_tokens=50, max_chars=1_000_000)) == [restated(text) for text in texts]
    assert apply(spark, texts, filter_tokens) == [restated(text, None) for text in texts]


def test_own_limits_and_stop_list(spark):
    texts = ["one two three four", "two"]
    assert apply(spark, texts, lambda t: filter_tokens(t, ["TWO"], 2)) == [["one", "three"], []]
    assert apply(spark, texts, lambda t: filter_tokens(t, [], None)) == [["one", "two", "three", "four"], ["two"]]
    assert apply(spark, ["abc def"], lambda t: filter_tokens(t, [], 5, max_chars=5)) == [["abc", "d"]]


def test_first_words_equal_a_slice_of_all(spark):
    texts = [" a b c d", "a", "", "!a!b!", "a b c", "A-b_c d e f g", None]
    for count in (1, 2, 3, 48):
        whole = apply(spark, texts, lambda t: F.slice(words(t), 1, count))
        assert apply(spark, texts, lambda t: first_words(t, count)) == whole


def test_sentences(spark):
    texts = ["One two.  Three!? \n\n Four", "...", "Dr. Smith came. He left.", None]
    assert apply(spark, texts, sentences) == [
        ["One two.", "Three!?", "Four"],
        [],
        ["Dr.", "Smith came.", "He left."],
        None,
    ]
    protected = apply(spark, texts, lambda t: sentences(t, ["Dr."]))
    assert protected[2] == ["Dr. Smith came.", "He left."]


def test_null_text_policy(spark):
    assert apply(spark, [None, "a"], as_text) == [None, "a"]
    assert apply(spark, [None, "a"], lambda t: as_text(t, "nan")) == ["nan", "a"]
    row = spark.range(1).select(as_text(F.lit(7)).alias("o")).first()
    assert row.o == "7"


def test_one_pattern_over_the_text(spark):
    rng = random.Random(11)
    letters = ["a", "Z", "é", "Σ", "İ", "ß", "7", "٣", "²", "½", "Ⅷ", "漢", "\U0001d49c", "\U0001d7d8", "\u0301", "_", "-", " ", "'", "\n"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(400)] + ["NUM num 7 the", "\U0001d49c7 7", "7\U0001d49c x"]
    each = lambda t: F.filter(F.transform(F.split(t, NON_WORD), lambda tok: _normal(tok, ["num", "z"])), lambda tok: tok != "")
    assert apply(spark, texts, lambda t: filter_tokens(t, ["NUM", "z"])) == apply(spark, texts, each)
    plan = spark.range(1).select(F.concat(F.lit("a "), "id").alias("t")).select(filter_tokens(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" in plan and "split(" not in plan
