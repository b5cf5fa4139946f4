import math
import random
import re
from collections import Counter

import pytest

from docspark.models.language import LanguageModel, fit_language_model, language_profile

WORDS = {"en": "the a of and house tree", "de": "der die und haus baum a", "fr": "le la et maison arbre a"}


def made(seed, n, noise=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        text = rng.choices(WORDS[lang].split(), k=rng.randint(3, 12)) + [f"x{rng.randint(0, 99)}" for _ in range(noise)]
        rows.append((i, " ".join(text), lang))
    return rows


def predict(fit, rows, max_terms):
    counts = {lang: Counter() for _, _, lang in fit}
    for _, text, lang in fit:
        counts[lang].update(text.split())
    totals = Counter()
    for counter in counts.values():
        totals.update(counter)
    known = sorted(totals, key=lambda t: (-totals[t], t))[:max_terms]
    size = {lang: sum(counter[t] for t in known) + len(known) for lang, counter in counts.items()}
    result = {}
    for i, text, _ in rows:
        terms = [t for t in re.split(r"\W+", text.lower()) if t in known]
        scores = {lang: sum(math.log((counts[lang][t] + 1) / size[lang]) for t in terms) for lang in counts}
        result[i] = max(sorted(scores), key=lambda lang: round(scores[lang], 9)) if terms else None
    return result


@pytest.mark.parametrize("max_terms", [None, 9])
def test_predictions_equal_brute_force(spark, max_terms):
    fit, rows = made(1, 200, noise=1), made(2, 150, noise=2) + [(900, "", None), (901, "unknown words", None), (902, None, None)]
    model = fit_language_model(spark.createDataFrame(fit, "i int, t string, lang string"), "t", "lang", max_terms=max_terms)
    scored = model.transform(spark.createDataFrame(rows, "i int, t string, lang string"), "t")
    assert scored.columns == ["i", "t", "lang", "prediction"]
    expected = predict(fit, [(i, t or "", lang) for i, t, lang in rows], max_terms)
    assert {row.i: row.prediction for row in scored.collect()} == expected


def test_held_out_texts(spark):
    model = fit_language_model(spark.createDataFrame(made(1, 200), "i int, t string, lang string"), "t", "lang")
    rows = model.transform(spark.createDataFrame(made(9, 100), "i int, t string, lang string"), "t").collect()
    assert sum(row.lang == row.prediction for row in rows) >= 97


def test_profile_holds_the_weights_of_the_model(spark):
    df = spark.createDataFrame(made(3, 60), "i int, t string, lang string")
    model = fit_language_model(df, "t", "lang")
    weights = {row.term: row.weights for row in model.profile.collect()}
    rows = language_profile(df, "t", "lang").collect()
    assert {row.lang for row in rows} == set(WORDS) and len(rows) == 18
    for row in rows:
        assert row.log_prob == pytest.approx(weights[row.term][model.labels.index(row.lang)])


def test_saved_model_gives_the_same_predictions(spark, tmp_path):
    df = spark.createDataFrame(made(3, 60), "i int, t string, lang string")
    model = fit_language_model(df, "t", "lang")
    model.save(str(tmp_path / "model"))
    again = LanguageModel.load(str(tmp_path / "model"))
    assert again.transform(df, "t").orderBy("i").collect() == model.transform(df, "t").orderBy("i").collect()


def test_character_runs(spark, tmp_path):
    rows = [(0, "日本語の文章です", "ja"), (1, "中文的文字是这样", "zh"), (2, "ab  ab", "xx")]
    df = spark.createDataFrame(rows, "i int, t string, lang string")
    model = fit_language_model(df, "t", "lang", gram=2)
    assert sorted(row.term for row in model.profile.collect()) == sorted(
        {t[i : i + 2] for t in ("日本語の文章です", "中文的文字是这样", "ab ab") for i in range(len(t) - 1)}
    )
    held = spark.createDataFrame([(0, "文章です"), (1, "文字是"), (2, "Ab"), (3, "q")], "i int, t string")
    model.save(str(tmp_path / "model"))
    for scorer in (model, LanguageModel.load(str(tmp_path / "model"))):
        assert [row.prediction for row in scorer.transform(held, "t").orderBy("i").collect()] == ["ja", "zh", "xx", None]
