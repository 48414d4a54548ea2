"""Composition of the waste stream: counts and shares per key.

One partial + final hash aggregate per call; ``count``/``sum`` are combined
map-side, so a brand holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import total_label

SHARES = list(C.CATEGORY_NAMES)


def _measures():
    return [
        F.expr("count(1)").alias("total_count"),
        F.expr("CAST(sum(CAST(is_compostable AS INT)) AS BIGINT)").alias("compostable_count"),
        F.expr("CAST(sum(CAST(is_recyclable AS INT)) AS BIGINT)").alias("recyclable_count"),
        F.expr("CAST(sum(CAST(is_trash AS INT)) AS BIGINT)").alias("trash_count"),
    ]


def counted(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and the three conditional counts per combination of ``keys``."""
    return prepared.groupBy(*keys).agg(*_measures())


def with_shares(agg: DataFrame, key: str) -> DataFrame:
    """Counts per ``key`` with their shares in percent."""
    return agg.selectExpr(
        f"`{key}`", "total_count", "compostable_count", "recyclable_count", "trash_count",
        "compostable_count / total_count * 100 AS compostable_pct",
        "recyclable_count / total_count * 100 AS recyclable_pct",
        "trash_count / total_count * 100 AS trash_pct",
    )


def composition(prepared: DataFrame, key: str, order: bool = True) -> DataFrame:
    """Row count, three conditional counts and their shares in percent per ``key``.

    ``prepared`` is the output of ``prepare``. Only keys that occur appear.
    """
    out = with_shares(counted(prepared, [key]), key)
    return out.orderBy(key) if order else out


def compositions(prepared: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The composition for several keys from ONE scan and ONE shuffle.

    A grouping-sets aggregate (``Expand`` + partial/final hash aggregate)
    replaces one full pass over the table per key. Nothing is cached here: a
    caller that uses several of the frames stores ``grouped`` first (see
    ``split_compositions``).
    """
    return split_compositions(grouped_compositions(prepared, keys), keys)


def grouped_compositions(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """The grouping-sets aggregate: a row for each value of each key, told apart by ``__gid``."""
    return (prepared.groupingSets([[k] for k in keys], *keys)
            .agg(*_measures(), F.grouping_id().alias("__gid")))


def split_compositions(grouped: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The composition of each key out of ``grouped_compositions`` rows."""
    out = {}
    n = len(keys)
    for i, k in enumerate(keys):
        gid = ((1 << n) - 1) ^ (1 << (n - 1 - i))  # every key but k aggregated away
        out[k] = with_shares(grouped.filter(F.col("__gid") == gid), k)
    return out


def composition_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Unpivot the three shares to ``(ids..., Category, Percentage)`` with display names.

    Planned as a single ``Expand`` over the (small) aggregate, no shuffle.
    """
    long = wide.unpivot(ids, SHARES, "Category", "Percentage")
    names = F.create_map(*[F.lit(x) for kv in C.CATEGORY_NAMES.items() for x in kv])
    return long.select(*ids, F.element_at(names, F.col("Category")).alias("Category"), "Percentage")


def brand_total_label(by_brand: DataFrame) -> DataFrame:
    """Per-brand total and its ``Total: n`` label, largest brands first."""
    return (by_brand.select("brand", "total_count", total_label("total_count").alias("label"))
            .orderBy(F.desc("total_count"), F.asc_nulls_first("brand")))
