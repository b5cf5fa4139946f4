import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspark.models.sentence_ends import SentenceEnds, abbreviation_scores, fit_sentence_ends, type_counts


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    nouns = [f"{a}{b}" for a in ("gar", "hou", "riv", "mount", "val") for b in ("den", "se", "er", "ain", "ley")]
    rows = []
    for i in range(200):
        text = []
        for _ in range(rng.randrange(3, 9)):
            subject = rng.choice(["Dr. Smith", "Mr. Jones", "The " + rng.choice(nouns), "He", "Prof. Braun"])
            text.append(f"{subject} saw the {rng.choice(nouns)} and the {rng.choice(nouns)}{rng.choice('...!?')}")
        rows.append((i, " ".join(text)))
    return spark.createDataFrame([*rows, (900, None), (901, " \n ")], "id long, text string").cache()


def test_scores_by_hand(docs):
    counts = type_counts(docs, "text")
    got = {r.type: r for r in counts.collect()}
    seen = Counter(t for r in docs.collect() for t in (r.text or "").split())
    assert got["dr"].with_period == seen["Dr."] and got["dr"].plain == 0
    words = sum(r.with_period + r.plain for r in got.values())
    periods = sum(r.with_period for r in got.values())
    scores = {r.type: r.score for r in abbreviation_scores(counts, words, periods).collect()}
    k, p = seen["Dr."], periods / words
    assert scores["dr"] == pytest.approx(2 * k * (math.log(0.99) - math.log(p)) * math.exp(-2))
    assert scores["house"] < 0.3


def test_periods_of_abbreviations_end_nothing(docs, spark, tmp_path):
    ends = fit_sentence_ends(docs, "text")
    assert {r.type for r in ends.abbreviations.collect()} == {"dr", "mr", "prof"}
    starters = {r.word for r in ends.starters.collect()}
    assert {"he", "the"} <= starters | {"the"} and "smith" not in starters
    rows = [(1, "He saw Dr. Smith. The house is old! Is it? (Yes.) It was Mr. Jones."), (2, "We met the Dr. He was late"), (3, None), (None, "One. Two")]
    texts = spark.createDataFrame(rows, "id long, text string")
    ends.save(str(tmp_path / "e"))
    for model in (ends, SentenceEnds.load(str(tmp_path / "e"))):
        got = {}
        for r in model.split(texts, "id", "text").orderBy("id", "pos").collect():
            got.setdefault(r.id, []).append(r.sentence)
        assert got[1] == ["He saw Dr. Smith.", "The house is old!", "Is it?", "(Yes.)", "It was Mr. Jones."]
        assert got[2] == ["We met the Dr.", "He was late"] and got[None] == ["One.", "Two"]
        assert 3 not in got


def test_empty_texts_learn_nothing(docs):
    ends = fit_sentence_ends(docs.where("id >= 900"), "text")
    assert ends.abbreviations.count() == 0 and ends.starters.count() == 0
    assert ends.split(docs.where(F.col("id") < 2), "id", "text").count() > 4


def test_a_long_text_is_cut_in_linear_time(spark):
    """Lists made anew for every sentence took minutes for this text."""
    text = "One two three four. " * 40_000
    docs = spark.createDataFrame([(1, text)], "i long, t string")
    model = SentenceEnds(spark.createDataFrame([], "type string"), spark.createDataFrame([], "word string"))
    start = time.perf_counter()
    rows = model.split(docs, "i", "t").agg(F.count("*"), F.max("pos"), F.min("sentence"), F.max("sentence")).first()
    assert tuple(rows) == (40_000, 39_999, "One two three four.", "One two three four.")
    assert time.perf_counter() - start < 60
