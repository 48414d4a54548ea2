"""JSON array files read by many tasks.

A large array file cannot be cut at line ends. It is read as text cut behind every
``}``, which Spark's text source does for any range of a file, and the cuts are put
right afterwards:

1. Each range (``spark.sql.files.maxPartitionBytes``) tells, for both cases that it
   begins inside or outside a quoted string, how its quotes turn that round and how
   its brackets change the nesting depth. Running sums over the ranges of a file give
   the true case and depth at the beginning of each: one row for each range.
2. Each range cuts itself at the commas between the elements of the array. Elements
   within a range leave as they are; the beginning of a range up to the first cut
   and the end from the last cut on are pieces, joined in their order over the ranges.

Elements are parsed by ``from_json``. An element that is not a JSON object of the
schema is kept apart with its text; so is what follows the array or is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from binsight.schema import ITEM_JSON
from binsight.session import scratch_path, ship_package

RANGES_AT_ONCE = 1_000_000  # ranges whose beginnings are broadcast (about 100 bytes each); beyond, rows are shuffled to them
_RANGE = ["file", "start"]
WHOLE, HEAD, TAIL = 0, 1, 2
_BAD = "_corrupt_record"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def marks(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions of brackets and commas outside of strings, their change of depth, inside a
    string at the end) of text that begins ``inside`` a string or not, and never after a backslash."""
    c = np.frombuffer(text, np.uint8)
    quote = c == 0x22
    slash = np.flatnonzero(c == 0x5C)
    if len(slash):  # a character behind an odd run of backslashes is escaped
        first = np.concatenate([[True], np.diff(slash) > 1])
        begin = np.maximum.accumulate(np.where(first, slash, 0))
        last = np.concatenate([first[1:], [True]])
        odd = slash[last & ((slash - begin) % 2 == 0)] + 1
        quote[odd[odd < len(c)]] = False
    before = (np.cumsum(quote) - quote + inside) & 1
    opens, closes = (c == 0x7B) | (c == 0x5B), (c == 0x7D) | (c == 0x5D)
    at = np.flatnonzero((opens | closes | (c == 0x2C)) & (before == 0))
    return at, opens[at].astype(np.int64) - closes[at], int((quote.sum() + inside) & 1)


def _runs(batches: Iterator, extra: list[str]) -> Iterator[tuple]:
    """(file, start, values of ``extra``, text, ends the range) from fragments in order, with the
    ``}`` that each was cut behind, but for the last one of a range whose column ``last`` is set."""
    held = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("file", "start", *extra)]
        values = batch.column("value").to_pylist()
        keys = list(zip(*cols))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if held is not None and held[0] != keys[a]:
                yield _run(*held, extra, True)
                held = None
            text = ([held[1]] if held is not None else []) + values[a:b]
            if len(text) > 1:
                yield _run(keys[a], "}".join(text[:-1]), extra, False)
            held = (keys[a], text[-1])
            a = b
    if held is not None:
        yield _run(*held, extra, True)


def _run(key: tuple, text: str, extra: list[str], ends: bool) -> tuple:
    file, start, *values = key
    if not ends or not dict(zip(extra, values)).get("last"):
        text += "}"
    return file, start, values, text.encode("utf-8", "surrogatepass"), ends


def _turns(batches: Iterator) -> Iterator:
    """One row a range: how it turns a string's inside and outside round, and changes the depth in both cases."""
    import pyarrow as pa
    flips, deep = 0, [0, 0]
    for file, start, _, text, ends in _runs(batches, []):
        for case in (0, 1):
            _, change, after = marks(text, (flips + case) & 1)
            deep[case] += int(change.sum())
        flips = after ^ 1  # of case 1
        if ends:
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "flips": flips, "outside": deep[0], "inside": deep[1]}],
                                             schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("flips", pa.int32()),
                                                               ("outside", pa.int64()), ("inside", pa.int64())]))
            flips, deep = 0, [0, 0]


def _cut(batches: Iterator) -> Iterator:
    """The elements and pieces of elements of each range."""
    import pyarrow as pa
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("depth", pa.int64()), ("text", pa.string())])
    rest, seen, case, depth, out = b"", False, 0, 0, []

    def row(kind: int, text: bytes) -> None:
        if text.strip() or kind != WHOLE:
            out.append({"file": file, "start": start, "kind": kind, "depth": depth, "text": text.decode("utf-8", "surrogatepass")})

    fresh = True
    for file, start, (inside, at_depth, _), text, ends in _runs(batches, ["inside_first", "depth_first", "last"]):
        if fresh:
            rest, seen, case, depth, fresh = b"", False, inside, at_depth, False
        at, change, case = marks(text, case)
        after = depth + np.cumsum(change)
        # a comma at depth 1, the bracket that opens the array, the one that closes it
        cuts = at[((change == 0) & (after == 1)) | ((change == 1) & (after == 1)) | ((change == -1) & (after == 0))]
        a = 0
        for cut in cuts.tolist():
            row(WHOLE if seen else HEAD, rest + text[a:cut])
            rest, seen, a = b"", True, cut + 1
        rest += text[a:]
        depth = int(after[-1]) if len(after) else depth
        if ends:
            row(TAIL if seen else HEAD, rest)
            fresh = True
        if ends or len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the elements of the arrays in the files of ``path``, as text, in no order."""
    ship_package(spark)
    turns = scratch_path(spark, "json-ranges")
    _fragments(spark, path).mapInArrow(_turns, "file string, start long, flips int, outside long, inside long").write.parquet(turns)
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = spark.read.parquet(turns).withColumn("inside_first", (F.coalesce(F.sum("flips").over(order), F.lit(0)) % 2).cast("int"))
    first = first.withColumn("change", F.when(F.col("inside_first") == 0, F.col("outside")).otherwise(F.col("inside")))
    first = first.select(*_RANGE, "inside_first", F.coalesce(F.sum("change").over(order), F.lit(0)).alias("depth_first"),
                         F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull().alias("last"))
    rows = _fragments(spark, path)
    if spark.read.parquet(turns).count() <= RANGES_AT_ONCE:
        rows = rows.join(F.broadcast(first), _RANGE)
    else:
        rows = rows.withColumn("n", F.monotonically_increasing_id()).join(first, _RANGE)
        rows = rows.repartition(*_RANGE).sortWithinPartitions(*_RANGE, "n")
    cut = scratch_path(spark, "json-elements")
    rows.mapInArrow(_cut, "file string, start long, kind int, depth long, text string").write.parquet(cut)
    found = spark.read.schema("file string, start long, kind int, depth long, text string").parquet(cut)
    # a tail begins an element, heads go on with it: at most two pieces a range
    pieces = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = (found.filter(F.col("kind") != WHOLE)
              .withColumn("element", F.sum((F.col("kind") == TAIL).cast("int")).over(pieces))
              .groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))
              .select("file", F.array_join(F.col("parts.text"), "").alias("text")))
    return found.filter(F.col("kind") == WHOLE).select("file", "text").union(joined).filter(F.trim(
        F.translate("text", "\n\r\t", "   ")) != "")


def read_array(spark: SparkSession, path: str, extra: list[T.StructField] | None = None) -> tuple[DataFrame, DataFrame]:
    """(feed rows, rejects) of item feeds that are JSON arrays, like ``json_items.read_feed``,
    but with any number of tasks for a file and no pass to learn the columns: the
    nine item fields and the ``extra`` ones. Rejects are (record, reason)."""
    schema = T.StructType([*ITEM_JSON.fields, *(extra or []), T.StructField(_BAD, T.StringType())])
    rows = elements(spark, path).select("text", F.from_json(
        "text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull() | ~F.ltrim(F.translate("text", "\n\r\t", "   ")).startswith("{")
    unnamed = F.col("r.filename").isNull()
    rejects = rows.filter(bad | unnamed).select(
        F.col("text").alias("record"), F.when(bad, F.lit("malformed")).otherwise(F.lit("no filename")).alias("reason"))
    return rows.filter(~bad & ~unnamed).select("r.*").drop(_BAD), rejects
