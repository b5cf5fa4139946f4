"""Rows that every operator must bear."""

#: Names that operators use inside or return; inputs may bear them too.
CLASHING = ["text_key", "keep_id", "kept", "size", "key", "part", "n", "items", "root", "bag", "word", "copies", "start", "runs", "_doc_id"]

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, other scripts.
ODD = [
    (1, "a b c d e f g\nx\ny\nz", "s1"),
    (1, "a b c d e f g\nx\ny\nz", "s1"),
    (2, "a b c d e f g\nx\ny\nz", "s1"),
    (None, "a b c d e f g \nx\ny\nz", "s2"),
    (3, None, None),
    (None, None, None),
    (4, "", "s2"),
    (5, " \n\t ", "s2"),
    (6, LONG, "s3"),
    (7, "žluťoučký 日本語 \U0001f600 naïve", None),
]
