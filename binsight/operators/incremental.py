"""Compositions kept up to date by signed changes instead of re-reading the table.

A change of rows is the counts of their new values minus those of their old
values, by hour and brand: at most one row for each pair that occurs. Counts plus
all changes give every composition of the dashboard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.operators.composition import counted, with_shares
from binsight.operators.prepare import prepare

KEYS = ["hour", "brand"]
COUNTS = ["total_count", "compostable_count", "recyclable_count", "trash_count"]


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in COUNTS))


def contributions(items: DataFrame, sign: int = 1) -> DataFrame:
    """What the rows add to the counts (``sign`` -1: take away), by hour and brand."""
    return counted(prepare(items), KEYS).select(*KEYS, *((F.col(c) * sign).alias(c) for c in COUNTS))


def change(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Change of the counts when ``old`` rows become ``new`` ones (None: rows that are new);
    pairs that keep their counts are left out."""
    rows = contributions(new)
    if old is not None:
        rows = rows.unionByName(contributions(old, -1))
    return _summed(rows).filter(F.greatest(*(F.abs(c) for c in COUNTS)) > 0)


def composition_of(counts: DataFrame, key: str) -> DataFrame:
    """The composition by ``key`` from counts and changes; keys without rows left are gone."""
    sums = counts.groupBy(key).agg(*(F.sum(c).alias(c) for c in COUNTS)).filter("total_count > 0")
    return with_shares(sums, key)
