"""Extraction over a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docspark.models.language import LanguageModel
from docspark.plans.extraction import documents_of_files
from docspark.sources.files import named_text

# Fixed schema of binary file rows.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_files(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    model: LanguageModel,
    language: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Extract the files that have arrived since the last run into Parquet below ``target``.

    A file is a document of its own, so batches are independent. Each writes the folder named by its
    id anew: a batch that is run again after a failure leaves its rows once.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", "*#category#*")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        documents_of_files(named_text(batch), model, language).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
