"""Brand ranking ("most wasteful" brands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def waste_by_brand(prepared: DataFrame) -> DataFrame:
    """Items per brand; every item counts, not only trash."""
    return prepared.groupBy("brand").agg(F.count(F.lit(1)).alias("total_waste_count"))


def top_brands(prepared: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` brands by item count, ties broken by brand (NULL first).

    ``orderBy + limit`` plans as ``TakeOrderedAndProject``: each partition keeps
    its own top ``n`` and only those reach the final merge.
    """
    return (waste_by_brand(prepared)
            .orderBy(F.desc("total_waste_count"), F.asc_nulls_first("brand"))
            .limit(n))


def top_from_counts(by_brand: DataFrame, n: int = 10, count_col: str = "total_count") -> DataFrame:
    """Top ``n`` from an existing per-brand aggregate (e.g. the brand composition),
    so a dashboard refresh scans and aggregates the table once, not twice."""
    return (by_brand.select("brand", F.col(count_col).alias("total_waste_count"))
            .orderBy(F.desc("total_waste_count"), F.asc_nulls_first("brand"))
            .limit(n))
