"""End-to-end jobs over the item table (see ``sources.table`` for its layout)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import basename
from binsight.operators import enrich as en
from binsight.operators import ingest as ing
from binsight.operators.composition import composition_long, grouped_compositions, split_compositions
from binsight.operators.merge import merge_update
from binsight.operators.prepare import prepare
from binsight.operators.ranking import top_from_counts
from binsight.schema import METADATA_FIELDS
from binsight.session import scratch_path
from binsight.sources import keys
from binsight.sources import table as tb
from binsight.sources.images import read_images
from binsight.sources.json_items import read_feed


def unseen(spark: SparkSession, rows: DataFrame, table_path: str, dedupe: bool = False) -> DataFrame:
    """The rows whose key the table does not hold; ``dedupe`` keeps one row a key."""
    if tb.exists(spark, table_path):
        return ing.new_only(rows, keys.known(spark, table_path), dedupe=dedupe)
    return ing.dedupe_by_key(rows) if dedupe else rows


def append_new(spark: SparkSession, rows: DataFrame, table_path: str, dedupe: bool = False,
               partitioned: bool = False) -> DataFrame:
    """Append the rows whose key is not in the table yet; returns what was appended.

    The check reads the bucketed key table. The new rows are stored first: they
    are appended and named in the key table from there.
    """
    rows = unseen(spark, rows, table_path, dedupe)
    path = scratch_path(spark, "new-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    tb.append(spark, rows, table_path, partitioned=partitioned)
    keys.add(spark, rows, table_path)
    return rows


def ingest_images(spark: SparkSession, image_dir: str, table_path: str,
                  state: str = C.DEFAULT_STATE, city: str = C.DEFAULT_CITY, dedupe: bool = False,
                  partitioned: bool = False) -> DataFrame:
    """Discover image files, shape them into pending items, append the unseen ones."""
    rows = ing.shape_files(read_images(spark, image_dir), state, city)
    return append_new(spark, rows, table_path, dedupe, partitioned)


def load_json_items(spark: SparkSession, path: str, table_path: str, multiline: bool = True,
                    strict_time: bool = False, partitioned: bool = False) -> DataFrame:
    """Append a feed's unseen items, with every column it brings; returns the
    records that were kept out (record, reason). A rerun appends nothing."""
    good, rejects = read_feed(spark, path, multiline)
    append_new(spark, ing.shape_feed(good, strict_time=strict_time), table_path, partitioned=partitioned)
    return rejects


IMAGES_AT_ONCE = 10_000  # image paths that the driver names in one read


def pending_images(spark: SparkSession, names: DataFrame, image_dir: str, at_once: int = IMAGES_AT_ONCE):
    """Frames (filename, content) that together read the images named in
    ``names`` (unique names) and no other file.

    The folder is listed without content and joined to the names; then each
    block of at most about ``at_once`` paths is read as a list of files.
    """
    found = scratch_path(spark, "pending-paths")
    listed = read_images(spark, image_dir).select(basename("path").alias("filename"), "path")
    listed.join(names.select("filename"), "filename", "left_semi").select("path").write.parquet(found)
    paths = spark.read.schema("path string").parquet(found)
    blocks = -(-paths.count() // at_once)
    for b in range(blocks):
        block = [r["path"] for r in paths.filter(F.expr(f"pmod(xxhash64(path), {blocks}) = {b}")).collect()]
        if block:
            yield read_images(spark, block).select(basename("path").alias("filename"), "content")


def enrich_pending(spark: SparkSession, table_path: str, image_dir: str, provider_factory: Callable,
                   strict: bool = False, **kw) -> tuple[int, DataFrame]:
    """Describe pending images and merge the valid answers into the table.

    Partitioned tables get a partition-scoped merge (only the capture dates
    holding answered rows are rewritten), unpartitioned ones a new snapshot.
    Only pending images are opened. Answers are written to the shared folder
    before the merge, so a retried merge never calls the provider again.
    ``strict`` raises on the first failing call or invalid answer, before
    anything is merged. Returns (snapshot number or -1, rejects).
    """
    tb.finish_merge(spark, table_path)
    waiting = en.pending(tb.read_table(spark, table_path)).select("filename").filter(F.col("filename").isNotNull())
    if waiting.isEmpty():
        return -1, spark.createDataFrame([], "filename string, reason string, answer string, error string")
    answers_path = scratch_path(spark, "answers")
    for images in pending_images(spark, waiting.distinct(), image_dir):
        en.ask(images, provider_factory, strict=strict, **kw).write.mode("append").parquet(answers_path)
    if not tb.committed(spark, answers_path):  # none of the pending items has a file
        return -1, spark.createDataFrame([], "filename string, reason string, answer string, error string")
    ok, bad = en.split_answers(spark.read.parquet(answers_path), dedupe=False)
    if strict:
        en.raise_if_any(bad)
    return merge_answers(spark, table_path, ok), bad


def touched_dates(spark: SparkSession, table_path: str, answers: DataFrame, key: str = "filename") -> list | None:
    """The capture dates that hold answered rows, at most the table's partitions;
    None for a table without partitions."""
    if not tb.is_partitioned(spark, table_path):
        return None
    items = tb.read_table(spark, table_path, keep_partition=True)
    touched = (items.select(key, tb.PARTITION_COL).join(answers.select(key), key, "left_semi")
               .select(tb.PARTITION_COL).distinct())
    return [r[0] for r in touched.collect()]


def merge_answers(spark: SparkSession, table_path: str, answers: DataFrame, key: str = "filename") -> int:
    """Merge stored answers into the item table; returns the snapshot.

    Partitioned tables: only the capture dates holding answered rows are
    rewritten (their list is bounded by the table's partition count).
    Otherwise the merged table is written as a new snapshot. Two answers for a
    key fail the job; rows appended meanwhile make it raise, never get lost.
    """
    tb.finish_merge(spark, table_path)
    fields = [c for c in METADATA_FIELDS if c in answers.columns]
    dates = touched_dates(spark, table_path, answers, key)
    if dates is not None:
        return tb.merge_partitions(spark, table_path, answers, key, fields, dates)
    items = tb.read_table(spark, table_path)
    return tb.replace(spark, merge_update(items, answers, key, fields), table_path, same_rows=True)


DASHBOARD_KEYS = ["hour", "brand"]


def dashboard(grouped: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """The three result tables (and long forms) of the composition dashboard from
    one ``dashboard_groups`` frame, which the caller stores if it uses several."""
    parts = split_compositions(grouped, DASHBOARD_KEYS)
    by_hour, by_brand = parts["hour"].orderBy("hour"), parts["brand"]
    return {
        "composition_by_hour": by_hour,
        "composition_by_hour_long": composition_long(by_hour, ["hour"]),
        "composition_by_brand": by_brand,
        "composition_by_brand_long": composition_long(by_brand, ["brand", "total_count"]),
        "top_brands": top_from_counts(by_brand, top_n),
    }


def dashboard_groups(items: DataFrame) -> DataFrame:
    """Both compositions' counts from one pass over the table: a row for each hour and brand."""
    return grouped_compositions(prepare(items), DASHBOARD_KEYS)


def publish_dashboard(spark: SparkSession, table_path: str, out_base: str, top_n: int = 10, keep: int = 3) -> None:
    """Recompute the dashboard from the newest table snapshot and publish each
    result as a committed snapshot under ``out_base/<name>``, the newest
    ``keep`` of which stay (readers use ``sources.table.read_table``). Run it on
    a timer (the dashboard refreshed every 30 s): enrichment merges change flags
    of existing rows, which only a re-read of the table sees."""
    path = scratch_path(spark, "dashboard")
    groups = dashboard_groups(tb.read_table(spark, table_path))
    groups.write.parquet(path)
    try:
        for name, df in dashboard(spark.read.schema(groups.schema).parquet(path), top_n).items():
            tb.replace(spark, df, f"{out_base.rstrip('/')}/{name}", keep=keep)
    finally:
        tb.delete(spark, path)
