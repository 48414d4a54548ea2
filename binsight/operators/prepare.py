"""Dashboard preparation of the item table.

The steps must run in this order: fill NULL flags, normalise the brand, make
the flags exclusive (recyclable wins), derive ``is_trash``, derive ``hour``.
After ``prepare`` exactly one of compostable / recyclable / trash is true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import hour_of_day


def fill_flags(df: DataFrame) -> DataFrame:
    """NULL compostable / recyclable -> False (un-enriched rows count as trash)."""
    return df.fillna({"is_compostable": False, "is_recyclable": False})


def normalize_brand(df: DataFrame, col: str = "brand") -> DataFrame:
    """Blank brand -> 'Other'; NULL stays NULL and forms its own group."""
    return df.withColumn(col, F.when(F.col(col) == C.UNKNOWN_BRAND, F.lit(C.OTHER_BRAND)).otherwise(F.col(col)))


def exclusive_flags(df: DataFrame) -> DataFrame:
    """Recyclable wins over compostable; the rest is trash. Run after ``fill_flags``."""
    return (df.withColumn("is_compostable", F.when(F.col("is_recyclable"), F.lit(False))
                          .otherwise(F.col("is_compostable")))
              .withColumn("is_trash", ~(F.col("is_compostable") | F.col("is_recyclable"))))


def with_hour(df: DataFrame, ts: str = "time", out: str = "hour") -> DataFrame:
    return df.withColumn(out, hour_of_day(ts))


def prepare(df: DataFrame) -> DataFrame:
    """All five steps in their order."""
    return with_hour(exclusive_flags(normalize_brand(fill_flags(df))))
