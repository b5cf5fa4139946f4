import pytest
from pyspark.sql import functions as F

from docspark.models.lemmas import common_start, induced_lemmas, pairs_of_vocabulary, suffix_rules
from docspark.operators.lookup import lookup_terms

PAIRS = [("cities", "city"), ("parties", "party"), ("cats", "cat"), ("dogs", "dog"), ("cars", "car"), ("running", "run"), ("went", "go"), ("sat", "sit"), ("the", "the"), ("bus", "bus")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([*PAIRS, ("cats", "cat"), (None, "x"), ("x", None)], "form string, lemma string")


def plain_rules(pairs, longest=6, least=2):
    counts = {}
    for form, lemma in pairs:
        start = next((i for i in range(min(len(form), len(lemma))) if form[i] != lemma[i]), min(len(form), len(lemma)))
        for k in range(min(len(form), longest) + 1):
            if k >= len(form) - start:
                rule = (len(form) - start, lemma[start:])
                counts.setdefault(form[len(form) - k :], {}).setdefault(rule, 0)
                counts[form[len(form) - k :]][rule] += 1
    best = {s: min((-n, *rule) for rule, n in rules.items()) for s, rules in counts.items()}
    return {s: (cut, add, -n) for s, (n, cut, add) in best.items() if -n >= least}


def test_rules_are_the_most_frequent_rewrites(pairs):
    rules = {r.suffix: (r.cut, r.add, r.n) for r in suffix_rules(pairs).collect()}
    assert rules == plain_rules(PAIRS)
    assert rules["ties"] == (3, "y", 2) and rules["s"] == (1, "", 3)


def test_unseen_forms_take_the_longest_suffix(spark, pairs):
    terms = spark.createDataFrame([(t,) for t in ["duties", "hats", "hats", "is", "s", "", "went", None, "überties", "blue"]], "term string")
    known = pairs.where("form IS NOT NULL AND lemma IS NOT NULL").distinct().select(F.col("form").alias("term"), F.col("lemma").alias("value"))
    got = {r.term: r.value for r in induced_lemmas(terms, suffix_rules(pairs), known).collect()}
    assert got == {"duties": "duty", "hats": "hat", "is": "is", "s": "s", "": "", "went": "go", "überties": "überty", "blue": "blue"}
    docs = spark.createDataFrame([(1, ["hats", "went", "blue", "other"])], "id long, tokens array<string>")
    table = induced_lemmas(terms, suffix_rules(pairs), known)
    assert lookup_terms(docs, ["id"], "tokens", table, "lemmas").first().lemmas == ["hat", "go", "blue", "other"]


def test_shared_starts(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", "x"), ("ab", "ab"), ("é\U0001f600a", "é\U0001f600b")], "a string, b string")
    assert [r[0] for r in rows.select(common_start(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 2]


def test_no_pairs_no_rules(spark, pairs):
    empty = suffix_rules(pairs.limit(0))
    assert empty.count() == 0
    assert induced_lemmas(spark.createDataFrame([("a",)], "term string"), empty).first().value == "a"


def test_pairs_from_a_vocabulary(spark):
    words = spark.createDataFrame([("cat", 9), ("cats", 4), ("as", 3), ("a", 2), ("dogs", 5)], "term string, df long")
    assert [tuple(r) for r in pairs_of_vocabulary(words, ["s", "ts"]).collect()] == [("cats", "cat")]
