"""Session helpers: a local builder for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Setting that bounds an Arrow batch between Spark and Python, and its bytes while this library writes files.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Folder of a local session that names none, and the folder of the current ``run_files`` block.
_local_folder: str | None = None
_run = ""


def local_session(app: str = "docspark", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="docspark-")
    return _local_folder


@contextmanager
def run_files(spark: SparkSession) -> Iterator[str]:
    """Drop at the end of the block what jobs in it have written below the shared folder.

    Results read such files lazily, so write or collect them within the block. Blocks do not nest.
    """
    global _run
    _run = f"run-{uuid.uuid4().hex}/"
    folder = f"{shared_dir(spark)}/docspark/{_run}"
    try:
        yield folder
    finally:
        _run = ""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has written yet."""
    return f"{shared_dir(spark)}/docspark/{_run}{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs of the block hand rows to Python ``BATCH_BYTES`` at a time, or fewer if the session says so.

    A batch is laid out beside Java's heap, up to three times while it grows, in every task of an executor.
    """
    old = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES if old is None else fewest(old, BATCH_BYTES)))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES) if old is None else spark.conf.set(ARROW_BYTES, old)


def fewest(said: str, most: int) -> int:
    """``most``, or the bytes that a setting names (``64m``, ``1024b``, ``1024``) if these are fewer; no bound if it is not above zero."""
    number = said.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    size = int(number[:-1] if unit else number) << unit
    return min(size, most) if size > 0 else most


def materialize(df: DataFrame, name: str, small: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs start from the files.

    Several fits then read one set of tokens or features, and a lost executor costs a re-read
    of its splits instead of the whole lineage. With ``small`` the rows reach Python in ``small_batches``; ``options`` are the writer's.
    """
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession) if small else nullcontext():
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once in buckets of ``key``: later joins and groups by the key do not move its rows.

    Like ``materialize``, with as many buckets as the session has shuffle partitions unless told
    otherwise. The files lie in the shared folder; the catalog names them only until the reader knows their buckets.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, name)
    table = f"docspark_{name}_{uuid.uuid4().hex}".replace("-", "_")
    with small_batches(spark):
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the entry alone: a table with a path keeps its files
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work a partition per core when the input has fewer.

    A small table in one file is read by one task. Large inputs have more splits than cores and
    pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
