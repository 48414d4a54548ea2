"""Live composition: the dashboard aggregates kept up to date over the item stream.

Complete-mode aggregation: the state is one row per key (24 hours, or the
number of brands), independent of the data volume. Each trigger publishes the
full, small result as a new committed snapshot (``sources.table``), so a
reader (``read_composition``) never sees a half-written result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from binsight.operators.composition import composition
from binsight.operators.prepare import prepare
from binsight.sources import table as tb


def start_composition(items_stream: DataFrame, key: str, out_path: str, checkpoint: str,
                      trigger: dict | None = None, keep: int = 3):
    """``trigger`` defaults to availableNow; the dashboard cadence is
    ``{"processingTime": "30 seconds"}``. The newest ``keep`` results stay.

    The number of state-store partitions is the session's
    ``spark.sql.shuffle.partitions`` at the first start (it is recorded in the
    checkpoint); a session for small keyed state sets it low.
    """
    spark = items_stream.sparkSession
    agg = composition(prepare(items_stream), key, order=False)

    def publish(batch, epoch_id):
        tb.replace(spark, batch, out_path, keep=keep)

    writer = (agg.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_composition(spark, out_path: str) -> DataFrame:
    """Newest published composition."""
    return tb.read_table(spark, out_path)
