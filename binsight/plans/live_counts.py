"""Counts beside the item table that follow its appends and merges.

``<table>_counts`` holds one batch of rows for each change (``operators.incremental``),
named by the caller: a batch that is published again after a failure is left
alone, so every change counts once. Readers sum all batches, a few rows for each
hour and brand, and never touch the items. ``fold`` adds up old batches.

A change is stored before the table is changed and published after. Whoever
repeats a batch that broke off (same name, same answers) takes the stored change,
merges again, which changes nothing more, and publishes. Batches of one table run
one after the other, and a batch that broke off is repeated before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.operators import incremental as inc
from binsight.operators.merge import merge_update
from binsight.plans import jobs
from binsight.schema import METADATA_FIELDS
from binsight.sources import table as tb


def counts_of(table: str) -> str:
    return f"{table.rstrip('/')}_counts"


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    return tb.read_table(spark, counts_of(table))


def composition(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The current composition of the table by ``hour`` or ``brand``."""
    return inc.composition_of(read_counts(spark, table), key)


def _published(spark: SparkSession, table: str, batch: str) -> bool:
    return tb.exists(spark, counts_of(table)) and not read_counts(spark, table).filter(F.col("batch") == batch).limit(1).isEmpty()


def _publish(spark: SparkSession, change: DataFrame, table: str, batch: str) -> None:
    """Append a batch; an empty one leaves a row of zeros, so that it is known."""
    zero = spark.createDataFrame([(None, None, *[0] * len(inc.COUNTS))], change.schema)
    rows = change.unionByName(zero).withColumn("batch", F.lit(batch))
    tb.append(spark, rows.coalesce(1), counts_of(table))


def start(spark: SparkSession, table: str) -> None:
    """Count the whole table once, as the batch ``start``."""
    if not _published(spark, table, "start"):
        _publish(spark, inc.change(None, tb.read_table(spark, table)), table, "start")


def _stored(spark: SparkSession, change: DataFrame, path: str) -> DataFrame:
    if not tb.committed(spark, path):
        change.write.mode("overwrite").parquet(path)
    return spark.read.schema(change.schema).parquet(path)


def merge(spark: SparkSession, table: str, answers: DataFrame, batch: str, work_dir: str, key: str = "filename") -> None:
    """Merge stored answers into the table (``jobs.merge_answers``) and carry the
    change of the answered rows over to the counts."""
    if _published(spark, table, batch):
        return
    tb.finish_merge(spark, table)
    fields = [c for c in METADATA_FIELDS if c in answers.columns]
    # only the dates with answered rows are read again
    items = tb.read_table(spark, table, keep_partition=True)
    days = jobs.touched_dates(spark, table, answers, key)
    if days is not None:
        items = items.filter(tb.on_dates(days))
    old = items.join(answers.select(key), key, "left_semi")
    change = _stored(spark, inc.change(old, merge_update(old, answers, key, fields)), f"{work_dir}/change-{batch}")
    jobs.merge_answers(spark, table, answers, key)
    _publish(spark, change, table, batch)
    tb.delete(spark, f"{work_dir}/change-{batch}")


def append(spark: SparkSession, table: str, rows: DataFrame, batch: str, partitioned: bool = False) -> None:
    """Append unseen rows (``jobs.append_new``) and add them to the counts. A batch
    that broke off between the two is found by its rows: those named by the batch
    but not counted are counted when it is repeated."""
    if _published(spark, table, batch):
        return
    path = f"{tb.base_of(spark, counts_of(table))}-work/rows-{batch}"
    if not tb.committed(spark, path):
        new = jobs.unseen(spark, rows, table)
        new.write.mode("overwrite").parquet(path)
    new = spark.read.schema(rows.schema).parquet(path)
    jobs.append_new(spark, new, table, partitioned=partitioned)
    _publish(spark, inc.change(None, new), table, batch)
    tb.delete(spark, path)


def fold(spark: SparkSession, table: str, keep: int = 100) -> None:
    """Add up all batches but the newest ``keep`` (by name) into the batch ``start``."""
    rows = read_counts(spark, table)
    names = sorted(r[0] for r in rows.select("batch").distinct().collect() if r[0] != "start")
    old = names[:-keep] if keep else names
    if not old:
        return
    past = F.col("batch").isin([*old, "start"])
    summed = (rows.filter(past).groupBy(*inc.KEYS).agg(*(F.sum(c).alias(c) for c in inc.COUNTS))
              .withColumn("batch", F.lit("start")))
    tb.replace(spark, summed.unionByName(rows.filter(~past)).coalesce(1), counts_of(table))
