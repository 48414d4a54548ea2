"""Item tables: parquet tables of Spark's catalog, written by Spark's own writers.

A table is named by the folder that it lives in (or by a plain name, then below
the shared folder) and is registered in the session's catalog. A catalog that
outlives the session (a metastore) keeps the registration; otherwise the next
session registers the folder again on first use.

* ``append`` creates the table or inserts by column name; new columns are added
  to the table.
* ``replace`` writes the next version of the table into a folder of its own and
  points the catalog to it, so readers never see half of it. Threads of one
  process may read, and ask whether there is a table, while another one does so.
* ``merge_partitions`` stores the merged rows of the touched capture dates
  beside the table, checks that nothing was appended to these dates meanwhile,
  and lets a dynamic partition overwrite insert the stored rows. If that breaks
  off, readers and appends raise ``MergePendingError`` until ``finish_merge``
  (called by the next merge) has repeated it from the stored rows.

Two merges of one table must not run at the same time.
"""

from __future__ import annotations

import hashlib
import threading
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binsight.session import shared_dir

PARTITION_COL = "capture_date"
_VERSION = "v"  # folders of the versions
#: Held while a table leaves the catalog and comes back with its next version, and by whatever
#: looks a table up, so that a reader in another thread neither misses it nor registers it itself.
_SWITCHING = threading.RLock()
_UNFINISHED: set[str] = set()  # versions that this process is writing: not there yet for its other threads


class SchemaConflictError(ValueError):
    pass


class TableMissingError(FileNotFoundError):
    pass


class UnmarkedTableError(RuntimeError):
    pass


class MergeConflictError(RuntimeError):
    pass


class MergePendingError(RuntimeError):
    pass


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def committed(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to ``path`` finished (``_SUCCESS`` present)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def base_of(spark: SparkSession, table: str) -> str:
    return table.rstrip("/") if "/" in table else f"{shared_dir(spark)}/tables/{table}"


def name_of(table: str) -> str:
    """The table's name in the catalog."""
    table = table.rstrip("/")
    return f"binsight_{hashlib.md5(table.encode()).hexdigest()}" if "/" in table else table


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _register(spark: SparkSession, table: str, schema: T.StructType, location: str, partitioned: bool,
              absent: str = "") -> None:
    by = f"PARTITIONED BY ({PARTITION_COL})" if partitioned else ""
    where = location.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {absent} {name_of(table)} ({_columns(schema)}) USING parquet "
              f"OPTIONS (partitionOverwriteMode 'dynamic') {by} LOCATION '{where}'")


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions in the table's folder, oldest first."""
    base = base_of(spark, table)
    try:
        found = spark.read.option("basePath", base).parquet(f"{base}/{_VERSION}=*")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise
    return sorted(r[0] for r in found.select(_VERSION).distinct().collect())


def location(spark: SparkSession, table: str) -> str:
    """Folder of the current version."""
    rows = spark.sql(f"DESCRIBE EXTENDED {name_of(table)}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def exists(spark: SparkSession, table: str) -> bool:
    """The table is in the catalog, or its folder holds a version, which is registered
    then. A version that no finished write marked is refused, not taken for absent."""
    with _SWITCHING:
        if spark.catalog.tableExists(name_of(table)):
            return True
        base = base_of(spark, table)
        found = [w for w in (f"{base}/{_VERSION}={n}" for n in versions(spark, table)) if w not in _UNFINISHED]
        if not found:
            return False
        where = found[-1]
        if not committed(spark, where):
            raise UnmarkedTableError(f"{where} holds files of an unfinished write; refusing to use it")
        schema = spark.read.option("mergeSchema", "true").parquet(where).schema
        partitioned = PARTITION_COL in schema.names
        # a thread that was stopped inside a switch may still be registering it
        _register(spark, table, schema, where, partitioned, absent="IF NOT EXISTS")
        if partitioned:
            spark.catalog.recoverPartitions(name_of(table))
        return True


def _require(spark: SparkSession, table: str, wait_s: float = 60.0) -> str:
    """Name of an existing table; waits a while for an overwrite that is going on."""
    if not exists(spark, table):
        raise TableMissingError(f"no table {table}")
    until = time.monotonic() + wait_s
    while committed(spark, _swapping(spark, table)):
        if time.monotonic() > until:
            raise MergePendingError(f"a merge of {table} broke off inside its overwrite; call finish_merge")
        time.sleep(0.5)
    return name_of(table)


def is_partitioned(spark: SparkSession, table: str) -> bool:
    return exists(spark, table) and PARTITION_COL in _found(spark, name_of(table)).columns


def with_partition(df: DataFrame, time_col: str = "time") -> DataFrame:
    return df if PARTITION_COL in df.columns else df.withColumn(PARTITION_COL, F.to_date(time_col))


def _found(spark: SparkSession, name: str) -> DataFrame:
    """The current version of a table of the catalog."""
    with _SWITCHING:
        spark.catalog.refreshTable(name)
        return spark.table(name)


def schema_of(spark: SparkSession, table: str) -> T.StructType:
    """The table's columns without the partition column."""
    return T.StructType([f for f in _found(spark, _require(spark, table)).schema.fields if f.name != PARTITION_COL])


def read_table(spark: SparkSession, table: str, schema: T.StructType | None = None,
               keep_partition: bool = False, wait_s: float = 60.0) -> DataFrame:
    """The table; columns added by later appends read as NULL in older rows. The
    partition column is dropped unless ``keep_partition``; ``schema`` picks columns.
    A missing table raises ``TableMissingError``."""
    df = _found(spark, _require(spark, table, wait_s))
    if PARTITION_COL in df.columns and not keep_partition:
        df = df.drop(PARTITION_COL)
    return df.select(*schema.names) if schema else df


def check_appendable(existing: T.StructType, incoming: T.StructType) -> None:
    """Shared columns must keep their type (parquet would only fail at read time)."""
    have = {f.name: f.dataType for f in existing.fields}
    for f in incoming.fields:
        if f.name in have and have[f.name] != f.dataType:
            raise SchemaConflictError(f"column {f.name}: table has {have[f.name].simpleString()}, "
                                      f"incoming has {f.dataType.simpleString()}")


def _clustered(df: DataFrame) -> DataFrame:
    """Cluster rows by capture date before a partitioned write: about one file
    per date instead of one per task and date; AQE splits a hot date
    (``REBALANCE`` hint, skew-aware) instead of sending it to one task."""
    return df.hint("rebalance", PARTITION_COL)


def _ordered(df: DataFrame, partitioned: bool) -> DataFrame:
    """Ready for a partitioned write: the partition column last, rows clustered by it."""
    if not partitioned:
        return df
    df = with_partition(df)
    return _clustered(df.select(*(c for c in df.columns if c != PARTITION_COL), PARTITION_COL))


def append(spark: SparkSession, df: DataFrame, table: str, partitioned: bool = False, wait_s: float = 60.0) -> None:
    """Insert by column name; creates the table if there is none (partitioned by
    capture date when ``partitioned``; an existing table keeps its own layout).
    New columns become part of the table, missing ones are NULL. A failing
    append raises and leaves the table as it was."""
    if not exists(spark, table):
        replace(spark, df, table, partitioned)
        return
    name = _require(spark, table, wait_s)
    known = schema_of(spark, table)
    check_appendable(known, df.schema)
    more = [f for f in df.schema.fields if f.name not in known.names and f.name != PARTITION_COL]
    if more:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_columns(T.StructType(more))})")
    if is_partitioned(spark, table):
        df = with_partition(df)
    have = {c.lower() for c in df.columns}
    rows = df.select(*(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in spark.table(name).schema.fields))
    (_clustered(rows) if PARTITION_COL in rows.columns else rows).write.insertInto(name)


def _counts(rows: DataFrame) -> DataFrame:
    """Rows for each capture date (in one group if the table is not partitioned)."""
    at = F.col(PARTITION_COL) if PARTITION_COL in rows.columns else F.lit(None).cast("date")
    return rows.groupBy(at.alias("day")).agg(F.count("*").alias("n"))


def _grown(now: DataFrame, before: DataFrame) -> bool:
    """Some capture date has more rows now than before."""
    now, before = _counts(now), _counts(before).withColumnRenamed("n", "m").withColumnRenamed("day", "old")
    more = now.join(before, F.col("day").eqNullSafe(F.col("old")), "left").filter("n > coalesce(m, 0)")
    return not more.limit(1).isEmpty()


def replace(spark: SparkSession, df: DataFrame, table: str, partitioned: bool = False, keep: int = 2,
            same_rows: bool = False) -> int:
    """Create or replace: write ``df`` as the next version, then switch to it; returns its number.

    ``df`` may read the table itself. ``same_rows`` says that it has a row for each
    row of the table: if the table has more when ``df`` is written, rows were
    appended meanwhile, ``MergeConflictError`` is raised and the table stays. The
    newest ``keep`` versions stay, so that readers of the one before can finish.
    """
    name, base = name_of(table), base_of(spark, table)
    known = exists(spark, table)
    n = int(location(spark, table).rsplit("=", 1)[1]) + 1 if known else 0
    where = f"{base}/{_VERSION}={n}"
    rows = _ordered(df, partitioned)
    _UNFINISHED.add(where)
    try:
        writer = rows.write.mode("overwrite")  # a version that was broken off is written anew
        (writer.partitionBy(PARTITION_COL) if partitioned else writer).parquet(where)
        if same_rows and known and _grown(read_table(spark, table, keep_partition=True), spark.read.schema(rows.schema).parquet(where)):
            delete(spark, where)
            raise MergeConflictError(f"{table} changed while its next version was written")
        with _SWITCHING:
            if known:
                spark.sql(f"DROP TABLE {name}")  # the files stay: their folder is named by the table
            _register(spark, table, rows.schema, where, partitioned)
            if partitioned:
                spark.catalog.recoverPartitions(name)
    finally:
        _UNFINISHED.discard(where)
    if n >= keep:
        delete(spark, f"{base}/{_VERSION}={n - keep}")
    return n


def _stored_merge(spark: SparkSession, table: str) -> str:
    return f"{base_of(spark, table)}/_merge"


def _swapping(spark: SparkSession, table: str) -> str:
    """Written when an overwrite from the stored rows begins, removed when it is done."""
    return f"{base_of(spark, table)}/_swapping"


def finish_merge(spark: SparkSession, table: str) -> bool:
    """Repeat the overwrite of a merge that broke off inside it; a merge that broke
    off before is forgotten. True if there was one to repeat."""
    if not exists(spark, table) or not committed(spark, _swapping(spark, table)):
        return False
    _overwrite(spark, table)
    return True


def _overwrite(spark: SparkSession, table: str) -> None:
    """Insert the stored rows over their capture dates, then forget them."""
    name, path = name_of(table), _stored_merge(spark, table)
    schema = spark.table(name).schema
    rows = spark.read.schema(schema).parquet(path).select(*schema.names)
    _clustered(rows).write.mode("overwrite").insertInto(name)
    delete(spark, _swapping(spark, table))
    delete(spark, path)


def on_dates(dates: list) -> Column:
    """The row is in one of these partitions (a filter that prunes the others)."""
    known = [d for d in dates if d is not None]
    cond = F.col(PARTITION_COL).isin(known) if known else F.lit(False)
    return cond | F.col(PARTITION_COL).isNull() if len(known) < len(dates) else cond


def merge_partitions(spark: SparkSession, table: str, source: DataFrame, key: str, columns: list[str],
                     dates: list) -> int:
    """Matched-update merge that rewrites only the ``dates`` partitions.

    ``dates`` (touched capture dates) is bounded by the table's partition count;
    only these partitions are scanned (``PartitionFilters``). Returns the
    number of the table's version.
    """
    from binsight.operators.merge import merge_update
    finish_merge(spark, table)
    n = int(location(spark, table).rsplit("=", 1)[1])
    if not dates:
        return n
    cond = on_dates(dates)
    path = _stored_merge(spark, table)
    merged = _clustered(merge_update(read_table(spark, table, keep_partition=True).filter(cond), source, key, columns))
    merged.write.mode("overwrite").partitionBy(PARTITION_COL).parquet(path)
    stored = spark.read.schema(merged.schema).parquet(path)
    if _grown(read_table(spark, table, keep_partition=True).filter(cond), stored):
        delete(spark, path)
        raise MergeConflictError(f"partitions of {table} changed while they were merged")
    spark.range(1).write.parquet(_swapping(spark, table))  # from here on readers and appends wait
    _overwrite(spark, table)
    return n
