"""Join helpers: only dimensions of a fixed size are forced into a broadcast.

Everything else is left to Spark: adaptive execution broadcasts a side whose
measured size is small and splits partitions of a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_dimension(df: DataFrame) -> DataFrame:
    """Broadcast a dimension whose row count is fixed by constants (rate tables)."""
    return F.broadcast(df)


def spread_nulls(df: DataFrame, key: str) -> Column:
    """The key as text for a join in which NULL matches nothing: a row without a
    key gets one of its own (a hash of the row behind a character that no key
    starts with), so such rows do not meet in one task. A function of the row
    alone, hence the same after a retry."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.xxhash64(*plain).cast("string")))
