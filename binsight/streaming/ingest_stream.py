"""Continuous ingest: every new arrival becomes a pending item, is described by
the provider and lands in the item table.

Optionally arrivals repeated within a time span are dropped in the stream's own
state first (``streaming.dedupe``). Per micro-batch (``foreachBatch``):

1. keep rows whose file name is not in the key table yet (left anti join against
   bucketed names: only the batch is shuffled);
2. ask the provider about them (``mapInPandas`` on the executors) and store
   the answers in the shared folder before using them, under the stream's own
   id; a replayed epoch of this stream (same files, same new rows) reuses the
   stored answers and never calls again, another stream never does;
3. apply valid answers to the new rows (matched update), store the epoch's rows,
   append them and add their names to the key table. A replayed epoch takes its
   stored rows and appends those that the table does not hold.

Rows with invalid answers are appended pending; ``plans.jobs.enrich_pending``
retries them later. The file source records processed files in the query
checkpoint, so each arrival is handled once across restarts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import basename
from binsight.operators import enrich as en
from binsight.operators import ingest as ing
from binsight.operators.merge import merge_update
from binsight.sources import keys
from binsight.sources import table as tb
from binsight.sources.images import stream_images
from binsight.streaming.dedupe import distinct_arrivals, rocksdb_state


def arrivals_from_images(spark: SparkSession, image_dir: str, **kw) -> DataFrame:
    files = stream_images(spark, image_dir, **kw)
    return files.select(basename("path").alias("filename"),
                        F.col("modificationTime").alias("time"), "content")


def ingest_batch(spark: SparkSession, batch: DataFrame, epoch_id: int, table_path: str, work_dir: str,
                 provider_factory: Callable | None, state: str = C.DEFAULT_STATE,
                 city: str = C.DEFAULT_CITY, partitioned: bool = False, **provider_kw) -> None:
    """One micro-batch. Nothing is cached: the new rows are recomputed from the
    batch's files, whose content is read only for the provider's calls; the
    finished rows are stored once and appended from there."""
    path = f"{work_dir}/rows/epoch={epoch_id}"
    replayed = tb.committed(spark, path)
    if replayed:  # the state of a de-duplicating stream is only carried on by a batch that is run
        batch.select("filename").write.format("noop").mode("overwrite").save()
    else:
        _finished_rows(spark, batch, epoch_id, table_path, work_dir, provider_factory, state, city,
                       **provider_kw).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    if replayed and tb.exists(spark, table_path):  # the append may have come through before
        rows = ing.new_only(rows, tb.read_table(spark, table_path).select("filename"))
    tb.append(spark, rows, table_path, partitioned=partitioned)
    keys.add(spark, rows, table_path)
    for done in ("rows", "answers"):  # an epoch before the last is never replayed
        tb.delete(spark, f"{work_dir}/{done}/epoch={epoch_id - 2}")


def _finished_rows(spark: SparkSession, batch: DataFrame, epoch_id: int, table_path: str, work_dir: str,
                   provider_factory: Callable | None, state: str, city: str, **provider_kw) -> DataFrame:
    """The batch's new items, described as far as the provider gave valid answers."""
    has_content = "content" in batch.columns
    shaped = ing.with_ingest_defaults(batch, state, city, keep=["content"] if has_content else None)
    new = ing.new_only(shaped, keys.known(spark, table_path)) if tb.exists(spark, table_path) else shaped
    items = new.drop("content")
    if provider_factory is None:
        return items
    content = F.col("content") if has_content else F.col("filename").cast("binary")
    ans_path = f"{work_dir}/answers/epoch={epoch_id}"
    if not tb.committed(spark, ans_path):  # a replayed epoch reuses its stored answers
        en.ask(new.select("filename", content.alias("content")), provider_factory,
               **provider_kw).write.mode("overwrite").parquet(ans_path)
    ok, _bad = en.split_answers(spark.read.parquet(ans_path))
    return merge_update(items, ok)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that names a stream's stored answers: made at its first start and
    kept beside its checkpoint, so a restart finds it and a new checkpoint does not."""
    path = f"{checkpoint.rstrip('/')}-id"
    if not tb.committed(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["id"]


def start_ingest(arrivals: DataFrame, table_path: str, checkpoint: str, work_dir: str,
                 provider_factory: Callable | None = None, trigger: dict | None = None,
                 distinct_within: str | None = None, **kw):
    """Start the ingest stream; ``arrivals`` has ``filename, time`` (+ optional ``content``).

    ``trigger`` defaults to ``availableNow`` (drain and stop, for back-fills
    and tests); pass ``{"processingTime": "30 seconds"}`` to run continuously.
    ``distinct_within`` drops arrivals repeated within that time in state.
    """
    spark = arrivals.sparkSession
    own = f"{work_dir.rstrip('/')}/{stream_id(spark, checkpoint)}"

    def run(batch, epoch_id):
        ingest_batch(spark, batch, epoch_id, table_path, own, provider_factory, **kw)

    rows = distinct_arrivals(arrivals, distinct_within) if distinct_within else arrivals
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    with rocksdb_state(spark):
        return writer.trigger(**(trigger or {"availableNow": True})).start()
