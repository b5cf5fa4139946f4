import random

from odd_rows import ODD

from docspark.llm.lines import dedup_lines


def plain(rows, width=3):
    first, out = {}, []
    lines = {(d is None, d, t): (t or "").split("\n") for d, t, *_ in rows}
    order = sorted(lines, key=lambda k: (k[0], k[1] or 0, k[2] or ""))
    for k in order:
        for i in range(len(lines[k]) - width + 1):
            first.setdefault(tuple(lines[k][i : i + width]), (k, i))
    for d, t, *_ in rows:
        k = (d is None, d, t)
        gone = set()
        for i in range(len(lines[k]) - width + 1):
            if first[tuple(lines[k][i : i + width])] != (k, i):
                gone.update(range(i, i + width))
        out.append((d, "\n".join(x for i, x in enumerate(lines[k]) if i not in gone), len(lines[k]), len(gone)))
    return sorted(out, key=str)


def test_odd_rows(odd, documents):
    found = dedup_lines(odd)
    assert found.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(ODD)
    assert dedup_lines(documents([])).count() == 0


def test_overlapping_windows_and_a_common_passage(documents):
    random.seed(5)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join([*random.choices(pool, k=random.randint(0, 9)), *(["p", "q", "r", "s"] if i % 3 == 0 else [])]), "s") for i in range(150)]
    got = dedup_lines(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
