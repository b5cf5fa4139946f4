import hashlib
import random
import re
import zlib

import numpy as np
from odd_rows import LONG, ODD

from docspark.llm.periodic import lag_scan, periodic_runs, run_report, surviving_segments, with_planted_runs


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_runs(words, least=12):
    """Every lag, every stretch; the least lag of a stretch is its period."""
    word, found = np.unique(words, return_inverse=True)[1] if words else np.zeros(0), {}
    for q in range(1, len(word) // 2 + 1):
        same = np.concatenate([[False], word[:-q] == word[q:], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = plain_planted(doc_id, plain_words(text))
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(kept))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def check(df, rows):
    got = run_report(periodic_runs(with_planted_runs(df))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)


def random_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
        return [rng.choice("xyz") for _ in range(rng.randrange(5))] + unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))] + ["q"]
    if kind == 2:
        return ["z"] * rng.randrange(30) + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(80))]
    if kind == 3:
        a, b = ["a"], ["b"]
        for _ in range(7):  # Fibonacci words are full of runs
            a, b = a + b, a
        return a
    return [f"w{i}" for i in range(rng.randrange(50))] * rng.randrange(1, 4)


def test_random_texts(documents):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(random_words(rng)), "s") for i in range(400)]
    check(documents(rows), rows)


def test_odd_rows(odd, documents):
    check(odd, [r for r in ODD if r[1] is not LONG] + [(6, LONG)])
    assert run_report(periodic_runs(with_planted_runs(documents([])))).count() == 0


def test_segments_are_stable():
    """Splits uncover new rare words: the outer pairs only look frequent until the middle goes."""
    text = "a b c d e f g h i j k l X a b c d e f g h i j k l"
    word = np.unique(text.split(), return_inverse=True)[1]
    starts, _ = surviving_segments(word, np.zeros(len(word), "int64"))
    assert len(starts) == 0
    word = np.array([1, 2] * 8 + [9] + [3] * 12)
    assert [x.tolist() for x in surviving_segments(word, np.zeros(len(word), "int64"))] == [[0, 17], [16, 29]]


def test_a_very_long_segment():
    """Few distinct words over a long text: nothing can be split, and no lag is compared place by place."""
    rng = np.random.default_rng(1)
    word = rng.integers(0, 3, 200_000)
    word[50_000:150_000] = np.tile(word[50_000:50_700], 143)[:100_000]
    runs = lag_scan(word, np.array([0]), np.array([len(word)]))
    longest = runs[np.argmax(runs[:, 1] - runs[:, 0])]
    assert longest[2] == 700 and longest[0] <= 50_000 and longest[1] >= 150_000
    for start, end, period in runs[::50]:
        assert (word[start : end - period] == word[start + period : end]).all()
