"""JSON item feeds: one JSON array per file (as the generator writes) or JSON lines.

An array file is not splittable (one task per file); bulk feeds should be JSON
lines, which split across tasks. The nine item fields have fixed types; further
fields keep the types that one inference pass finds (pass ``extra`` to skip it),
so a feed can add columns to the table. Records that are not JSON objects are
kept apart, never turned into empty rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binsight.schema import ITEM_JSON

_BAD = "_corrupt_record"


def read_feed(spark: SparkSession, path: str, multiline: bool = True,
              extra: list[T.StructField] | None = None) -> tuple[DataFrame, DataFrame]:
    """(feed rows, rejects): rejects are (record, reason) of malformed records and
    of records without a file name, the key of every later step."""
    def reader():
        return spark.read.option("multiLine", multiline).option("columnNameOfCorruptRecord", _BAD)

    known = {f.name for f in ITEM_JSON.fields}
    if extra is None:
        extra = [f for f in reader().json(path).schema.fields if f.name not in known | {_BAD}]
    schema = T.StructType([*ITEM_JSON.fields, *extra, T.StructField(_BAD, T.StringType())])
    rows = reader().schema(schema).json(path)
    bad, unnamed = F.col(_BAD).isNotNull(), F.col("filename").isNull()
    rejects = rows.filter(bad | unnamed).select(
        F.when(bad, F.col(_BAD)).otherwise(F.to_json(F.struct(*(c for c in rows.columns if c != _BAD)))).alias("record"),
        F.when(bad, F.lit("malformed")).otherwise(F.lit("no filename")).alias("reason"))
    return rows.filter(~bad & ~unnamed).drop(_BAD), rejects


def read_json_items(spark: SparkSession, path: str, multiline: bool = True,
                    extra: list[T.StructField] | None = None) -> DataFrame:
    """The good rows of a feed."""
    return read_feed(spark, path, multiline, extra)[0]


def write_json_items(df: DataFrame, path: str, time_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> None:
    """JSON lines, written in parallel (one file per partition)."""
    df.write.mode("overwrite").option("timestampFormat", time_format).option(
        "timestampNTZFormat", time_format).json(path)
