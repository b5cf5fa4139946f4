import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import CLASHING, ODD  # noqa: E402

@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, clashing=True):
        df = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
        if clashing:
            df = df.selectExpr("*", *[f"'other' AS {c}" for c in CLASHING])
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)
