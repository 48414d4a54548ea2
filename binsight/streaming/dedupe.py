"""Arrivals told apart by key in the state of the stream.

A notification that is repeated within a time span of its first arrival is dropped
in the stream's state, before anything is joined or asked. The watermark lets old
keys go, so the state holds the keys of that span, in RocksDB on the executors'
disks. What comes again later is caught by the item table's key table.

The span is one of arrival (the batch's time, which a repeated batch takes from the
checkpoint), not of capture: a watermark over capture times would drop every item
that arrives late.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.operators.joins import spread_nulls

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB (a running stream keeps its provider)."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def distinct_arrivals(arrivals: DataFrame, within: str, key: str = "filename") -> DataFrame:
    """``arrivals`` without the rows whose key arrived before, up to ``within`` (an
    interval such as ``1 hour``) ago. No other row is dropped.

    Rows without a key are told apart by their other columns.
    """
    rows = arrivals.withColumns({"__key": spread_nulls(arrivals, key), "__at": F.current_timestamp()})
    return rows.withWatermark("__at", within).dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__at")
