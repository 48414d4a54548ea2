"""Image directory source (``binaryFile``), batch and streaming.

The scan is non-recursive; files whose names start with ``.`` or ``_``,
zero-length files and sub-directories are skipped by the file source. Ingest selects only ``path``
and ``modificationTime``, so the image bytes are pruned from the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binsight.schema import BINARY_FILE


def read_images(spark: SparkSession, directory: str | list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(directory)


def stream_images(spark: SparkSession, directory: str, glob: str | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded file source: each new file once (tracked in the query checkpoint).
    Writers should move finished files in atomically (rename), never write in place."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(directory)
