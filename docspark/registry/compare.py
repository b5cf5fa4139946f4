"""Run registered queries against their SQL and report rows, columns and values that differ.

    python -m docspark.registry.compare [sf dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from docspark.registry.oracle import ORACLE
from docspark.registry.queries import QUERIES
from docspark.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "f":
            frame[name] = frame[name].astype("float64") + 0.0
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark, folder: str, name: str) -> str:
    start = time.time()
    mine = QUERIES[name](spark, folder).toPandas()
    took = time.time() - start
    if name not in ORACLE:
        return f"rows-only {len(mine)} rows {took:.1f}s"
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    theirs = con.execute(ORACLE[name]).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"DIFF columns {list(mine.columns)} {list(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"DIFF rows {len(mine)} {len(theirs)}"
    a, b = normal(mine), normal(theirs)
    kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a.columns if a[c].dtype != b[c].dtype]
    for column in a.columns:
        unequal = ~((a[column] == b[column]) | (a[column].isna() & b[column].isna()))
        if unequal.any():
            i = unequal.idxmax()
            shown = [str({k: str(v)[:60] for k, v in side.loc[i].items()}) for side in (a, b)]
            return f"DIFF {int(unequal.sum())} of {len(a)} in {column}: {shown[0]} | {shown[1]}"
    return f"ok {len(a)} rows {took:.1f}s {kinds or ''}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session("compare", 8)
    for query in sys.argv[2:] or QUERIES:
        try:
            print(query, compare(session, folder, query), flush=True)
        except Exception as error:  # noqa: BLE001
            print(query, "ERROR", str(error)[:400], flush=True)
