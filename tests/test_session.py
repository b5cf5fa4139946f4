import os
import subprocess
import sys

from docspark.session import materialize, run_files

SCRIPT = """
from docspark.session import local_session, materialize, shared_dir
from docspark.registry.queries import QUERIES
spark = local_session("bare", 2, 2, "1g")
assert not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir()
assert shared_dir(spark) == shared_dir(spark)
assert QUERIES["tokens_persisted"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_a_local_session_without_a_checkpoint_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_files_of_a_run_can_be_dropped(spark):
    with run_files(spark) as folder:
        df = materialize(spark.range(5), "some")
        assert df.count() == 5 and len(os.listdir(folder.removeprefix("file:"))) == 1
    assert not os.path.exists(folder.removeprefix("file:"))
    assert materialize(spark.range(5), "some").count() == 5


def test_files_are_written_from_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from docspark import session

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    monkeypatch.setattr(session, "BATCH_BYTES", 1 << 16)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "array_repeat('abcdefgh', 50) AS t").mapInArrow(sizes, "n long")
    old = spark.conf.get(session.ARROW_BYTES)
    for said, most in ((old, 1 << 16), ("20k", 20 << 10)):
        spark.conf.set(session.ARROW_BYTES, said)
        found = [r.n for r in session.materialize(rows, "sizes", small=True).collect()]
        assert len(found) > 20 and max(found) < 1.2 * most and spark.conf.get(session.ARROW_BYTES) == said
    spark.conf.set(session.ARROW_BYTES, old)
    assert [session.fewest(x, 5 << 20) for x in ("-1", "64m", "2MB", "1024b", "77", "1g")] == [5 << 20, 5 << 20, 2 << 20, 1024, 77, 5 << 20]
