"""Ingest: shape discovered files / feed rows into items and keep only unseen ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import basename, parse_time
from binsight.operators.joins import spread_nulls
from binsight.schema import ITEM, ITEM_COLUMNS


def with_ingest_defaults(df: DataFrame, state: str = C.DEFAULT_STATE, city: str = C.DEFAULT_CITY,
                         keep: list[str] | None = None) -> DataFrame:
    """``(filename, time)`` -> the nine item columns with ingest defaults
    (plus the ``keep`` columns, e.g. image bytes, after them).

    A blank description marks a row as not enriched yet; the three flags are
    typed NULLs and the brand is blank (unknown).
    """
    return df.select(
        "filename", "time",
        F.lit(state).alias("state"), F.lit(city).alias("city"),
        F.lit(C.PENDING_DESCRIPTION).alias("description"),
        F.lit(None).cast("boolean").alias("is_recyclable"),
        F.lit(None).cast("boolean").alias("is_compostable"),
        F.lit(None).cast("boolean").alias("is_metal"),
        F.lit(C.UNKNOWN_BRAND).alias("brand"),
        *(keep or []),
    )


def shape_files(files: DataFrame, state: str = C.DEFAULT_STATE, city: str = C.DEFAULT_CITY) -> DataFrame:
    """binaryFile rows -> items. Only ``path`` and ``modificationTime`` are read:
    column pruning keeps the image bytes out of the scan."""
    base = files.select(basename("path").alias("filename"), F.col("modificationTime").alias("time"))
    return with_ingest_defaults(base, state, city)


def shape_feed(feed: DataFrame, strict_time: bool = False) -> DataFrame:
    """JSON feed rows (``time`` as ISO text) -> items in canonical column order.

    Columns missing from the feed become typed NULLs; extra columns are kept
    after the nine canonical ones (additive schema evolution by name).
    """
    cols = []
    for f in ITEM.fields:
        if f.name == "time":
            cols.append(parse_time(F.col("time"), strict=strict_time).alias("time")
                        if "time" in feed.columns else F.lit(None).cast("timestamp").alias("time"))
        elif f.name in feed.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in feed.columns if c not in ITEM_COLUMNS]
    return feed.select(*cols, *extra)


def dedupe_by_key(df: DataFrame, key: str = "filename") -> DataFrame:
    """One row per key (an aggregate: partial per partition, so hot keys collapse
    early). A NULL key tells nothing apart, so rows without a key all stay."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "filename",
             dedupe: bool = False) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing`` (left anti join).

    NULL keys never match and are always kept; they are spread over the join's
    tasks. Duplicates inside the batch are kept unless ``dedupe``. The join's
    sides are plain columns; Spark broadcasts the table's keys if they turn out
    small, and else splits a hot key of the batch (AQE skew join).
    """
    if dedupe:
        incoming = dedupe_by_key(incoming, key)
    known = existing.select(F.col(key).cast("string").alias("__own")).filter("__own is not null")
    return incoming.withColumn("__own", spread_nulls(incoming, key)).join(known, "__own", "left_anti").drop("__own")


def union_by_name(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append in memory with additive schema evolution: missing columns -> NULL."""
    return existing.unionByName(incoming, allowMissingColumns=True)
