"""Matched-update merge of enrichment results into the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.operators.joins import spread_nulls
from binsight.schema import METADATA_FIELDS


DUPLICATE = "merge source has duplicate"


class DuplicateKeyError(ValueError):
    pass


def assert_unique_keys(source: DataFrame, key: str) -> None:
    """Raise if a key occurs twice in the merge source. Runs the source as a job:
    call it on stored frames."""
    dup = source.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"merge source has duplicate {key}: {dup[0][0]!r}")


def merge_update(target: DataFrame, source: DataFrame, key: str = "filename",
                 columns: list[str] | None = None) -> DataFrame:
    """Target rows with ``columns`` replaced by the source's values on a key match.

    Never inserts or deletes; unmatched target rows and all other columns are
    untouched. A NULL source value overwrites (``when(matched)``, not
    ``coalesce``). The source is grouped by key inside the plan, and a key with
    two rows fails the job (``raise_error``), so it can never multiply rows and
    nothing runs while the plan is built. Target rows without a key match nothing.
    """
    columns = list(columns or METADATA_FIELDS)
    message = F.concat(F.lit(f"{DUPLICATE} {key}: "), F.col(key).cast("string"))
    src = (source.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.count("*").alias("__n"), F.first(F.struct(*columns)).alias("__new"))
           .select(F.col(key).alias("__key"),
                   F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("__matched"),
                   "__new"))
    joined = (target.withColumn("__own", spread_nulls(target, key))
              .join(src.withColumn("__key", F.col("__key").cast("string")), F.col("__own") == F.col("__key"), "left"))
    out = [F.when(F.col("__matched"), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
           for c in target.columns]
    return joined.select(*out)
