"""The most frequent values of an unbounded stream, in a state of a fixed size.

The state is one summary of frequent items (Spark's ``approx_top_k`` sketch, which
merges over tasks and batches). It names candidates and never misses a value
that makes up more than a known share of all rows. Each batch publishes the
sketch's candidates; ``top_values`` counts those exactly in the stored rows and
says whether the answer is proven: the last of the top must be above what a value
outside of the sketch can have. If it is not, all values are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.sources import table as tb

TRACKED = 4096  # counters of the sketch
#: Estimates are wrong by at most this share of the rows (of the sketch's algorithm:
#: 3.5 divided by the size of its map, which is not below its counters).
SHARE = 3.5 / TRACKED
NONE = "\x00"  # stands for a missing value, which the sketch does not count


def start_top(rows: DataFrame, column: str, out: str, checkpoint: str, trigger: dict | None = None):
    """Keep the sketch of ``column`` (text) over a stream; the table ``out`` gets
    (rows, sketch) after every batch."""
    spark = rows.sparkSession
    value = F.coalesce(F.col(column).cast("string"), F.lit(NONE))
    state = rows.select(value.alias("value")).groupBy(F.lit(1).alias("all")).agg(
        F.count("*").alias("rows"), F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("sketch"))

    def publish(batch: DataFrame, _epoch: int) -> None:
        found = batch.select("rows", F.expr(f"approx_top_k_estimate(sketch, {TRACKED // 4})").alias("found"))
        # a value that is no candidate is not above the last of a full list by more than the sketch's error
        last = F.when(F.size("found") == TRACKED // 4, F.array_min("found.count")).otherwise(F.lit(0))
        tb.replace(spark, found.select("rows", F.col("found.item").alias("candidates"), last.cast("long").alias("last")), out)

    writer = state.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def top_values(spark: SparkSession, out: str, stored: DataFrame, column: str, n: int = 10) -> tuple[DataFrame, bool]:
    """((value, count) of the ``n`` most frequent values of ``stored``, proven by the sketch alone).

    ``stored`` holds the rows that the stream has seen. Ties go to the smaller value,
    a missing one first. Only rows of candidates are counted if that is proven
    to be enough.
    """
    seen = tb.read_table(spark, out).first()
    candidates = seen["candidates"] if seen else []  # at most a quarter of the counters
    value = F.coalesce(F.col(column).cast("string"), F.lit(NONE))

    def counted(rows: DataFrame) -> DataFrame:
        return (rows.groupBy(column).agg(F.count("*").alias("count"))
                .orderBy(F.desc("count"), F.asc_nulls_first(column)).limit(n))

    if candidates:
        top = counted(stored.filter(value.isin(candidates)))
        rows = top.collect()  # n rows
        if len(rows) == n and rows[-1]["count"] > SHARE * seen["rows"] + seen["last"]:
            return spark.createDataFrame(rows, top.schema), True
    return counted(stored), False
