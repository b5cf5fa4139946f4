"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores. Every query runs once to
warm up and then three times; the median is reported. Results are consumed in full by a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from docspark.registry.queries import QUERIES
from docspark.session import local_session

HEADLINE = (
    "clean_documents",
    "strip_html",
    "token_filter",
    "vocab_prune",
    "bag_of_words",
    "lang_predict",
    "rejoin_segments",
    "sentence_vote",
    "document_sequences",
    "sentence_sequences",
    "classification_report",
    "majority_vote",
    "minibatch",
    "early_stop",
)
ONCE = ("head_train", "svm_predict")


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(3)), 3)
    if not sys.argv[1:]:
        for name in ONCE:
            seconds[name] = round(run(spark, folder, name), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
