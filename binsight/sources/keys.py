"""Key tables: the file names of an item table, bucketed by name.

A trigger that checks its arrivals against the known names reads the key table
bucket by bucket and shuffles only its own rows: the join's table side needs no
exchange. The table is derived from the item table. Whoever appends items adds
their names (``add``); a key table that is missing, or that other writers have
left behind, is made again from the items (``rebuild``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.session import scratch_path
from binsight.sources import table as tb

KEY = "filename"


def name_of(table: str) -> str:
    """The key table's name in the catalog."""
    return f"{tb.name_of(table)}_keys"


def _write(spark: SparkSession, names: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Append names; rows are dealt out as the buckets are, so every bucket gets one file."""
    names = names.select(F.col(KEY).cast("string").alias(KEY)).filter(F.col(KEY).isNotNull()).distinct()
    writer = (names.repartition(buckets, KEY).write.mode("append").format("parquet")
              .bucketBy(buckets, KEY).sortBy(KEY))
    (writer.option("path", path) if path else writer).saveAsTable(name_of(table))


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name_of(table)}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def rebuild(spark: SparkSession, table: str, buckets: int | None = None) -> None:
    """Make the key table from the item table's names, one file a bucket (so a rebuild also
    compacts what many small appends left). The number of buckets, by default that
    of shuffle partitions, is the number of tasks that a check gets."""
    names = tb.read_table(spark, table).select(KEY)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"DROP TABLE IF EXISTS {name_of(table)}")
    _write(spark, names, table, buckets, scratch_path(spark, "keys"))


def known(spark: SparkSession, table: str) -> DataFrame:
    """The names (column ``filename``) of an item table's rows, from its key table."""
    if not spark.catalog.tableExists(name_of(table)):
        rebuild(spark, table)
    spark.catalog.refreshTable(name_of(table))
    return spark.table(name_of(table))


def add(spark: SparkSession, rows: DataFrame, table: str) -> None:
    """Add the names of rows that were appended to the item table. Names that are
    there already do no harm: the check is an anti join."""
    if not spark.catalog.tableExists(name_of(table)):
        rebuild(spark, table)  # holds the new rows as well
        return
    _write(spark, rows, table, _buckets(spark, table))
