import math
import random
from collections import Counter

import pytest

from docspark.models.ngram import BACKOFF, NgramModel, fit_ngrams


def made(seed, n):
    """Classes with the same words in another order: only pairs tell them apart."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(["back", "forth"])
        circle = "red green blue white black".split()
        place, text = rng.randrange(5), []
        for _ in range(12):
            step = rng.choice([1, 1, 1, 2]) * (1 if name == "forth" else -1)
            place = (place + step) % 5
            text.append(circle[place])
        rows.append((i, " ".join(text + [f"x{rng.randrange(40)}"]), name))
    return rows


def brute(fit, rows, max_grams):
    names = sorted({name for _, _, name in fit})
    counts = {name: Counter() for name in names}
    for _, text, name in fit:
        ws = text.split()
        counts[name].update((False, w) for w in ws)
        counts[name].update((True, f"{a} {b}") for a, b in zip(ws, ws[1:]))
    total = sum(counts.values(), Counter())
    kept = set(sorted(total, key=lambda g: (-total[g], *g))[:max_grams])
    singles = [g for g in kept if not g[0]]
    size = {name: sum(counts[name][g] for g in singles) + len(singles) for name in names}

    def score(name, ws):
        result = 0.0
        for before, word in zip([None, *ws], ws):
            pair, known = (True, f"{before} {word}"), (False, word) in kept
            if before and pair in kept and counts[name][pair]:
                result += math.log(counts[name][pair] / counts[name][(False, before)])
                continue
            share = ((counts[name][(False, word)] if known else 0) + 1) / size[name]
            result += math.log(share if before is None else BACKOFF * share)
        return result

    return {
        i: max(names, key=lambda name: round(score(name, (text or "").split()), 8)) if (text or "").split() else None
        for i, text, *_ in rows
    }


@pytest.mark.parametrize("max_grams", [None, 30])
def test_classes_equal_brute_force(spark, max_grams):
    fit, held = made(1, 200), made(2, 150) + [(900, None, ""), (901, "", ""), (902, "new words only", ""), (903, "red", "")]
    model = fit_ngrams(spark.createDataFrame(fit, "i int, t string, c string"), "t", "c", max_grams=max_grams)
    got = model.predict(spark.createDataFrame(held, "i int, t string, c string").repartition(3), ["i"], "t")
    assert {row.i: row.prediction for row in got.collect()} == brute(fit, held, max_grams)


def test_word_order_is_learned_and_saved(spark, tmp_path):
    model = fit_ngrams(spark.createDataFrame(made(1, 200), "i int, t string, c string"), "t", "c")
    model.save(str(tmp_path / "model"))
    held = made(3, 100)
    df = spark.createDataFrame(held, "i int, t string, c string")
    for scorer in (model, NgramModel.load(str(tmp_path / "model"))):
        got = {row.i: row.prediction for row in scorer.predict(df, ["i"], "t").collect()}
        assert sum(got[i] == name for i, _, name in held) >= 95
