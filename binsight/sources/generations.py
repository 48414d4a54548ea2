"""A feed table whose columns may become wider over time.

Rows are kept in generations, each an item table (``sources.table``) of its own with
fixed types. Rows that bring a wider type for a column begin the next generation;
those of the same types go on with the newest, new columns included. A reader
gets the union, every generation read by its own types and cast to the newest.

A type is wider if every value of the narrower one keeps its value. Narrower or
unrelated types raise ``SchemaConflictError`` and nothing is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binsight.sources import table as tb

_INTEGERS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}  # decimal digits
#: Types in which each value of the type in front stays what it is.
_WIDER = {"float": {"double"}, "date": {"timestamp_ntz"}, "tinyint": {"float", "double"}, "smallint": {"float", "double"},
          "int": {"double"}}


def widens(old: T.DataType, new: T.DataType) -> bool:
    """``new`` holds every value of ``old``; bigint to double only if each value is a double, see ``append``."""
    a, b = old.simpleString(), new.simpleString()
    if b in _WIDER.get(a, ()) or (a, b) == ("bigint", "double"):
        return True
    if a in _INTEGERS and b in _INTEGERS:
        return _INTEGERS[a] < _INTEGERS[b]
    if isinstance(new, T.DecimalType):
        whole = _INTEGERS.get(a) or (old.precision - old.scale if isinstance(old, T.DecimalType) else None)
        scale = old.scale if isinstance(old, T.DecimalType) else 0
        return whole is not None and a != b and new.precision - new.scale >= whole and new.scale >= scale
    return False


def _no_double(name: str) -> Column:
    """The bigint of this column changes its value as a double. Beyond 2^53 only multiples of
    powers of two are doubles; those next to 2^63 round up to it, which no bigint is."""
    as_double = F.col(name).cast("double")
    return (as_double >= F.lit(2.0 ** 63)) | (as_double.try_cast("bigint") != F.col(name))


def _generation(base: str, n: int) -> str:
    return f"{base.rstrip('/')}/g{n}"


def generations(spark: SparkSession, base: str) -> list[str]:
    """The generations' tables, oldest first."""
    out: list[str] = []
    while tb.exists(spark, _generation(base, len(out))):
        out.append(_generation(base, len(out)))
    return out


def append(spark: SparkSession, df: DataFrame, base: str) -> int:
    """Append by column name; returns the number of the generation that got the rows.

    A bigint column becomes double only while all its values are doubles (checked
    by a query over that column).
    """
    gens = generations(spark, base)
    if not gens:
        tb.append(spark, df, _generation(base, 0))
        return 0
    newest = {f.name: f.dataType for f in tb.schema_of(spark, gens[-1]).fields}
    wider = [f for f in df.schema.fields if f.name in newest and newest[f.name] != f.dataType]
    for f in wider:
        if not widens(newest[f.name], f.dataType):
            raise tb.SchemaConflictError(f"column {f.name}: table has {newest[f.name].simpleString()}, "
                                         f"incoming has {f.dataType.simpleString()}")
    if not wider:
        tb.append(spark, df, gens[-1])
        return len(gens) - 1
    for f in wider:
        if f.dataType == T.DoubleType() and newest[f.name] == T.LongType():
            if not read(spark, base).filter(_no_double(f.name)).limit(1).isEmpty():
                raise tb.SchemaConflictError(f"column {f.name}: the table has integers that are no doubles")
    have = set(df.columns)
    rows = df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in newest.items() if c not in have))
    order = [*newest, *(c for c in df.columns if c not in newest)]
    tb.append(spark, rows.select(*order), _generation(base, len(gens)))
    return len(gens)


def read(spark: SparkSession, base: str) -> DataFrame:
    """All rows with the newest types; columns that an older generation lacks are NULL."""
    gens = generations(spark, base)
    if not gens:
        raise tb.TableMissingError(f"no table {base}")
    schema = tb.schema_of(spark, gens[-1])

    def cast(table: str) -> DataFrame:
        rows = tb.read_table(spark, table)
        have = set(rows.columns)
        return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))

    return reduce(DataFrame.union, map(cast, gens))
