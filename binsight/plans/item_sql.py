"""SQL over the items with values that are passed, never pasted into the text.

``items`` becomes a temporary view and ``items_of_brand(brand)`` a temporary table
function over it. Values reach the statements as named markers; a column that is
asked for by name is an identifier marker and must be one of the items' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binsight.schema import ITEM_COLUMNS

VIEW = "items"


def register(spark: SparkSession, items: DataFrame) -> None:
    """Make the view and the table function in the session; earlier ones are replaced."""
    items.select(*ITEM_COLUMNS).createOrReplaceTempView(VIEW)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*ITEM_COLUMNS).schema.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION items_of_brand(wanted STRING) RETURNS TABLE({columns}) "
              f"RETURN SELECT * FROM {VIEW} WHERE brand <=> wanted")


def of_brand(spark: SparkSession, brand: str | None) -> DataFrame:
    """The items of a brand; None gives those without one. Needs ``register``."""
    return spark.sql("SELECT * FROM items_of_brand(CAST(:brand AS STRING))", args={"brand": brand})


def count_by(spark: SparkSession, key: str, since=None) -> DataFrame:
    """(key, count) of the items, from a time on if ``since`` is given. Needs ``register``."""
    if key not in ITEM_COLUMNS:
        raise ValueError(f"no item column {key!r}")
    return spark.sql(f"SELECT IDENTIFIER(:key) AS key, COUNT(*) AS count FROM {VIEW} "
                     "WHERE :since IS NULL OR time >= :since GROUP BY IDENTIFIER(:key)", args={"key": key, "since": since})
