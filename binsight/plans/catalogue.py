"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the shared test tables (through ``sources.driver_tables``)
in full; none is cut to an id range, a prefix or a row cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions import columns as fc
from binsight.operators import classify as cl
from binsight.operators import composition as comp
from binsight.operators import enrich as en
from binsight.operators import ingest as ing
from binsight.operators import merge as mg
from binsight.operators import prepare as pr
from binsight.operators import ranking as rk
from binsight.operators import synth as sy
from binsight.operators.prepare import prepare
from binsight.schema import ITEM_COLUMNS, METADATA_FIELDS
from binsight.sources import driver_tables as dt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@register("scan_items")
def q_scan_items(spark, d):
    return dt.items(spark, d)


@register("composition_by_hour")
def q_composition_by_hour(spark, d):
    return comp.composition(prepare(dt.items(spark, d)), "hour")


@register("composition_by_brand")
def q_composition_by_brand(spark, d):
    return comp.composition(prepare(dt.items(spark, d)), "brand", order=False)


@register("composition_one_pass")
def q_composition_one_pass(spark, d):
    """Brand composition taken from the dashboard's single grouping-sets pass
    (hour and brand aggregated together)."""
    return comp.compositions(prepare(dt.items(spark, d)), ["hour", "brand"])["brand"]


@register("composition_by_hour_long")
def q_composition_by_hour_long(spark, d):
    wide = comp.composition(prepare(dt.items(spark, d)), "hour", order=False)
    return comp.composition_long(wide, ["hour"])


@register("composition_by_brand_long")
def q_composition_by_brand_long(spark, d):
    wide = comp.composition(prepare(dt.items(spark, d)), "brand", order=False)
    return comp.composition_long(wide, ["brand", "total_count"])


# ---- scalar operators on the item table ------------------------------------

MODEL = "trash1"


@register("ingest_shape")
def q_ingest_shape(spark, d):
    return ing.with_ingest_defaults(dt.items(spark, d).select("filename", "time"))


@register("path_basename")
def q_path_basename(spark, d):
    return dt.paths(spark, d).select("path", fc.basename("path").alias("filename"))


@register("parse_timestamp")
def q_parse_timestamp(spark, d):
    return dt.iso_times(spark, d).select("event_id", fc.parse_time("time_text", zoned=False).alias("time"),
                                         "time_text")


@register("append_merge_schema")
def q_append_merge_schema(spark, d):
    existing, incoming = dt.known_and_listed(spark, d)
    incoming = incoming.drop("city").withColumn("source", F.lit("feed"))
    return ing.union_by_name(existing, incoming)


@register("new_items_anti")
def q_new_items_anti(spark, d):
    existing, incoming = dt.known_and_listed(spark, d)
    return ing.new_only(incoming, existing)


@register("dedupe_by_key")
def q_dedupe_by_key(spark, d):
    existing, incoming = dt.known_and_listed(spark, d)
    return ing.dedupe_by_key(existing.select("filename").unionByName(incoming.select("filename")))


@register("pending_items")
def q_pending_items(spark, d):
    return en.pending(dt.items(spark, d)).select("filename", "time")


@register("pending_count")
def q_pending_count(spark, d):
    return en.pending(dt.items(spark, d)).agg(F.count(F.lit(1)).alias("pending_count"))


@register("null_fill_flags")
def q_null_fill_flags(spark, d):
    return pr.fill_flags(dt.items(spark, d)).select("filename", "is_compostable", "is_recyclable")


@register("brand_normalize")
def q_brand_normalize(spark, d):
    return pr.normalize_brand(dt.items(spark, d)).select("filename", "brand")


@register("exclusive_flags")
def q_exclusive_flags(spark, d):
    return (pr.exclusive_flags(pr.fill_flags(dt.items(spark, d)))
            .select("filename", "is_compostable", "is_recyclable", "is_trash"))


@register("hour_of_day")
def q_hour_of_day(spark, d):
    return pr.with_hour(dt.items(spark, d)).select("filename", "hour")


@register("brand_total_label")
def q_brand_total_label(spark, d):
    return comp.brand_total_label(comp.composition(prepare(dt.items(spark, d)), "brand", order=False))


@register("waste_by_brand")
def q_waste_by_brand(spark, d):
    return rk.waste_by_brand(prepare(dt.items(spark, d)))


@register("top_brands")
def q_top_brands(spark, d):
    return rk.top_brands(prepare(dt.items(spark, d)), 10)


@register("sql_count_by")
def q_sql_count_by(spark, d):
    dt.items(spark, d).createOrReplaceTempView("items")
    return spark.sql("SELECT brand, COUNT(*) AS count FROM items GROUP BY brand")


@register("sql_filter_eq")
def q_sql_filter_eq(spark, d):
    dt.items(spark, d).createOrReplaceTempView("items")
    return spark.sql("SELECT * FROM items WHERE brand = 'Brand#19'")


@register("sql_items_of_brand")
def q_sql_items_of_brand(spark, d):
    """The table function with the brand as an argument."""
    from binsight.plans import item_sql
    item_sql.register(spark, dt.items(spark, d))
    return item_sql.of_brand(spark, "Brand#19")


@register("sql_count_by_args")
def q_sql_count_by_args(spark, d):
    """Key column and start time as arguments."""
    import datetime

    from binsight.plans import item_sql
    item_sql.register(spark, dt.items(spark, d))
    return item_sql.count_by(spark, "is_recyclable", datetime.datetime(2024, 1, 10))


@register("capture_name")
def q_capture_name(spark, d):
    return dt.items(spark, d).select("filename", fc.capture_name("time").alias("image_path"))


@register("keyword_flag")
def q_keyword_flag(spark, d):
    part = dt.table(spark, d, "part").select("p_partkey", "p_name")
    adj = F.element_at(F.array(*[F.lit(a) for a in C.ADJECTIVES]),
                       (F.pmod(F.col("p_partkey"), F.lit(len(C.ADJECTIVES))) + 1).cast("int"))
    desc = F.concat_ws(" ", adj, F.col("p_name"))
    return part.select("p_partkey", desc.alias("description"),
                       desc.contains(dt.METAL_PART_WORD).alias("is_metal"))


# ---- classification ---------------------------------------------------------

@register("label_lookup")
def q_label_lookup(spark, d):
    return cl.label_lookup(dt.scores(spark, d), MODEL)


@register("ranked_labels")
def q_ranked_labels(spark, d):
    return cl.ranked_labels(dt.scores(spark, d), MODEL)


@register("top_label")
def q_top_label(spark, d):
    return cl.top_label(dt.scores(spark, d), MODEL)


@register("top_label_raw")
def q_top_label_raw(spark, d):
    return cl.top_label_raw(dt.scores(spark, d), MODEL)


@register("top_label_models")
def q_top_label_models(spark, d):
    return cl.top_label(dt.model_scores(spark, d), None)


@register("classification_report")
def q_classification_report(spark, d):
    return cl.classification_report(dt.scores(spark, d), dt.items(spark, d), MODEL)


@register("confidence_text")
def q_confidence_text(spark, d):
    labels = dt.scores(spark, d).select("key", F.inline("scores"))
    return labels.select("key", "label", fc.percent_text("score").alias("confidence_text"))


def _scorer_factory():
    return cl.ComponentScorer(dt.SCORE_LABELS)


@register("classify_batch")
def q_classify_batch(spark, d):
    return cl.classify_images(dt.embedding_images(spark, d), MODEL, _scorer_factory)


# ---- enrichment -------------------------------------------------------------

@register("base64_payload")
def q_base64_payload(spark, d):
    df = dt.payload(spark, d).select("doc_id", fc.base64_text("content").alias("b64"),
                                     fc.request_document("content").alias("request"))
    return df.select("doc_id", F.length("b64").alias("payload_length"), F.md5("b64").alias("payload_md5"),
                     F.length("request").alias("request_length"), F.md5("request").alias("request_md5"))


@register("parse_metadata")
def q_parse_metadata(spark, d):
    return en.parse_answers(dt.answers(spark, d)).select("filename", *METADATA_FIELDS, "is_valid")


@register("answer_rejects")
def q_answer_rejects(spark, d):
    return en.split_answers(en.parse_answers(dt.answers(spark, d)), dedupe=False)[1]


def _provider_factory():
    return en.NumberedProvider()


@register("enrich_batch")
def q_enrich_batch(spark, d):
    rows = en.pending(dt.items(spark, d)).select("filename", F.col("filename").cast("binary").alias("content"))
    ok, _rejected = en.enrich(rows, _provider_factory, backoff_s=0.0)
    return ok


@register("enrich_by_content")
def q_enrich_by_content(spark, d):
    """The documents as images, many of them copies: one question for each content."""
    from binsight.operators import by_content as bc
    from binsight.session import scratch_path
    images = dt.payload(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"),
                                         F.coalesce("content", F.lit(b"")).alias("content"))
    ok, _ = bc.describe(images.select("filename"), lambda names: images.join(names, "filename", "left_semi"),
                        scratch_path(spark, "by-content"), bc.SizeProvider, backoff_s=0.0)
    return ok


@register("merge_update")
def q_merge_update(spark, d):
    ok, _ = en.split_valid(en.parse_answers(dt.answers(spark, d)))
    return mg.merge_update(dt.items(spark, d), ok)


@register("merge_in_place")
def q_merge_in_place(spark, d):
    """merge_update through the table: date-partitioned write, answers stored,
    only the touched capture dates rewritten, table read back."""
    from binsight.plans.jobs import merge_answers
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    table, ans = scratch_path(spark, "merge-table"), scratch_path(spark, "merge-answers")
    tb.append(spark, dt.items(spark, d), table, partitioned=True)
    ok, _ = en.split_valid(en.parse_answers(dt.answers(spark, d)))
    ok.write.parquet(ans)
    merge_answers(spark, table, spark.read.parquet(ans))
    return tb.read_table(spark, table)


@register("composition_live")
def q_composition_live(spark, d):
    """Composition by hour from stored counts: the table is counted once, then two
    merges of answers carry only their signed changes over."""
    from binsight.plans import live_counts as live
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    table, work = scratch_path(spark, "live"), scratch_path(spark, "live-work")
    tb.append(spark, dt.items(spark, d), table, partitioned=True)
    live.start(spark, table)
    ok, _ = en.split_valid(en.parse_answers(dt.answers(spark, d)))
    ok.write.parquet(f"{work}/answers")
    ok = spark.read.schema(ok.schema).parquet(f"{work}/answers")
    half = F.pmod(F.xxhash64("filename"), F.lit(2)) == 0
    live.merge(spark, table, ok.filter(half), "merge-1", work)
    live.merge(spark, table, ok.filter(~half), "merge-2", work)
    return live.composition(spark, table, "hour")


@register("ingest_by_keys")
def q_ingest_by_keys(spark, d):
    """The described items, then twice the whole folder, checked against the bucketed key table."""
    from binsight.plans.jobs import append_new
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    table = scratch_path(spark, "keyed")
    existing, listed = dt.known_and_listed(spark, d)
    for rows in (existing, listed, listed):
        append_new(spark, rows, table)
    return tb.read_table(spark, table)


# ---- synthetic data ---------------------------------------------------------

def _end_hour(spark, d):
    """Last event hour as TIMESTAMP_NTZ (``date_trunc`` returns a zoned timestamp;
    casting back keeps the wall clock independent of the session time zone)."""
    return F.date_trunc("hour", dt.table(spark, d, "events").agg(F.max("ts")).scalar()).cast("timestamp_ntz")


@register("hour_spine")
def q_hour_spine(spark, d):
    return sy.hour_spine(spark, _end_hour(spark, d))


@register("weighted_pick")
def q_weighted_pick(spark, d):
    ev = dt.table(spark, d, "events").select("event_id")
    u = F.pmod(F.col("event_id"), F.lit(1000)) / F.lit(1000.0)
    return sy.weighted_pick(ev, u).select("event_id", "brand")


@register("rate_lookup")
def q_rate_lookup(spark, d):
    ep = dt.events_parts(spark, d)
    u = F.pmod(F.col("event_id"), F.lit(1000)) / F.lit(1000.0)
    df = sy.weighted_pick(ep, u).select(
        fc.indexed_name("event_id").alias("filename"),
        F.when(F.pmod(F.col("k"), F.lit(10)) == 1, F.lit(None).cast("string")).otherwise(F.col("brand")).alias("brand"),
        F.hour("ts").alias("hour"))
    return sy.rate_lookup(df).select("filename", "recycling_prob", "compost_prob")


@register("synth_items")
def q_synth_items(spark, d):
    ids = dt.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return sy.synth_items(ids, _end_hour(spark, d), "python", seed=0)


@register("synth_items_matlab")
def q_synth_items_matlab(spark, d):
    ids = dt.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return sy.synth_items(ids, _end_hour(spark, d), "matlab", seed=11)


# ---- sources and sinks: given tables written out and read back ----------------

@register("replace_snapshot")
def q_replace_snapshot(spark, d):
    """Create-or-replace: the pending items, then all items as the next snapshot."""
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    path, items = scratch_path(spark, "replaced"), dt.items(spark, d)
    tb.replace(spark, en.pending(items), path)
    tb.replace(spark, items, path, keep=1)
    return tb.read_table(spark, path)


@register("json_round_trip")
def q_json_round_trip(spark, d):
    """All items exported as JSON lines and read as a feed."""
    from binsight.session import scratch_path
    from binsight.sources.json_items import read_json_items, write_json_items
    path = scratch_path(spark, "feed")
    write_json_items(dt.items(spark, d), path)
    feed = read_json_items(spark, path, multiline=False)
    wall = feed.withColumn("wall", fc.parse_time("time", zoned=False))
    return ing.shape_feed(wall).drop("time").withColumnRenamed("wall", "time").select(*ITEM_COLUMNS)


@register("feed_schema_evolution")
def q_feed_schema_evolution(spark, d):
    """Described items in the table, then a feed of all items with one more column."""
    from binsight.plans.jobs import load_json_items
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    from binsight.sources.json_items import write_json_items
    path, feed = scratch_path(spark, "evolved"), scratch_path(spark, "feed")
    items = dt.items(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    tb.append(spark, items.filter("description <> ''"), path)
    number = F.regexp_extract("filename", r"^(\d+)", 1).cast("long")
    write_json_items(items.withColumn("weight", number / 2), feed)
    load_json_items(spark, feed, path, multiline=False)
    return tb.read_table(spark, path).select("filename", "description", "brand", "weight")


FEED_ROWS = 100_000  # items of one array file


def _array_feed(spark, d) -> str:
    """JSON array files of all items, with brackets, quotes and escapes in some texts;
    the last element of each has no file name. A file holds about ``FEED_ROWS`` items."""
    from binsight.session import scratch_path
    path = scratch_path(spark, "array")
    items = dt.items(spark, d)
    number = F.regexp_extract("filename", r"^(\d+)", 1).cast("long")
    hostile = F.when(number % 3 == 0, F.concat("description", F.lit('"}],[{\\"'))).when(
        number % 3 == 1, F.concat("description", F.lit("\\"))).otherwise(F.col("description"))
    rows = items.withColumn("description", hostile).withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"))
    text = F.concat(F.to_json(F.struct(*rows.columns)), F.lit(","))
    files = max(1, -(-dt.table(spark, d, "events").count() // FEED_ROWS))
    file = F.pmod(F.xxhash64("filename", "time"), F.lit(files))
    ends = spark.range(files).select(F.col("id").alias("file"), F.inline(F.array(*(
        F.struct(F.lit(place).alias("place"), F.lit(x).alias("value")) for place, x in ((0, "["), (2, '{"brand": "end"}'), (3, "]"))))))
    lines = rows.select(file.alias("file"), F.lit(1).alias("place"), text.alias("value")).union(ends)
    (lines.repartition(files, "file").sortWithinPartitions("file", "place").select("value", "file")
     .write.partitionBy("file").option("maxRecordsPerFile", 0).text(path))
    return path


FEED_RANGES = 256  # that a feed of 16 MB or more is read in at least


def _range_size(spark, path: str) -> int:
    """Bytes of a range: 64 KB for a small feed, the session's size for a large one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(64 << 10, min(size // FEED_RANGES, 128 << 20))


@register("json_array_feed")
def q_json_array_feed(spark, d):
    """The array files read by many tasks: each in ranges, of 64 KB for a small feed."""
    from binsight.sources.json_array import read_array
    path = _array_feed(spark, d)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(_range_size(spark, path)))
    try:
        good, _ = read_array(spark, path)
        return good.select("filename", fc.parse_time("time", zoned=False).alias("time"), "description", "brand", "is_recyclable")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@register("feed_type_evolution")
def q_feed_type_evolution(spark, d):
    """Weights of the items that come as int, then bigint, then double, by a third of the items each."""
    from binsight.session import scratch_path
    from binsight.sources import generations as gen
    base = scratch_path(spark, "widened")
    number = F.regexp_extract("filename", r"^(\d+)", 1).cast("int")
    rows = dt.items(spark, d).select("filename", "brand", number.alias("weight"))
    third = lambda i: rows.filter(F.col("weight") % 3 == i)
    gen.append(spark, third(0), base)
    gen.append(spark, third(1).withColumn("weight", F.col("weight").cast("bigint") * 4_000_000_000), base)
    gen.append(spark, third(2).withColumn("weight", F.col("weight") / 4), base)
    return gen.read(spark, base)


@register("feed_rejects")
def q_feed_rejects(spark, d):
    """Feed lines of which one in fifty is no JSON and one in fifty has no file name."""
    from binsight.session import scratch_path
    from binsight.sources.json_items import read_feed
    path = scratch_path(spark, "feed")
    number = F.col("event_id").cast("string")
    m = F.pmod(F.col("event_id"), F.lit(50))
    line = (F.when(m == 0, F.concat(F.lit("not json {"), number))
            .when(m == 25, F.concat(F.lit('{"brand": "b'), number, F.lit('"}')))
            .otherwise(F.concat(F.lit('{"filename": "'), number, F.lit('.jpg"}'))))
    dt.table(spark, d, "events").select(line.alias("value")).write.text(path)
    return read_feed(spark, path, multiline=False)[1]


def _rendered_documents(spark, d) -> str:
    """The documents' texts written as files, a folder for each source."""
    from binsight.session import scratch_path
    path = scratch_path(spark, "files")
    dt.table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy(
        "source").text(path)
    return f"{path}/*"


def _bytes_by_source(files):
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("content")).cast("long").alias("total_bytes"))


@register("binary_scan")
def q_binary_scan(spark, d):
    from binsight.sources.images import read_images
    return _bytes_by_source(read_images(spark, _rendered_documents(spark, d)))


@register("stream_files")
def q_stream_files(spark, d):
    """The new-file source over the same files, drained once."""
    from binsight.session import scratch_path
    from binsight.sources.images import stream_images
    out = scratch_path(spark, "seen")
    q = (stream_images(spark, _rendered_documents(spark, d)).select("path", "content").writeStream.format("parquet")
         .option("checkpointLocation", scratch_path(spark, "seen-ckpt")).trigger(availableNow=True).start(out))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return _bytes_by_source(spark.read.schema("path string, content binary").parquet(out))


@register("iso_text")
def q_iso_text(spark, d):
    return dt.table(spark, d, "events").select("event_id", fc.iso_text("ts").alias("time_text"))


@register("last_dotted")
def q_last_dotted(spark, d):
    return dt.paths(spark, d).select("path", fc.last_dotted("path").alias("suffix"))


# ---- streaming ----------------------------------------------------------------

@register("stream_composition")
def q_stream_composition(spark, d):
    from binsight.session import scratch_path
    from binsight.streaming.composition_stream import read_composition, start_composition
    out, ckpt = scratch_path(spark, "composition"), scratch_path(spark, "composition-ckpt")
    q = start_composition(dt.items_from(dt.stream_events_parts(spark, d)), "hour", out, ckpt)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_composition(spark, out)


@register("stream_lifecycle")
def q_stream_lifecycle(spark, d):
    """Pending items through their life cycle: asked, one in five rejected, asked
    again when its timer expires, merged."""
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    from binsight.streaming.lifecycle import SecondTry, start_lifecycle, wait_described
    arrivals = dt.stream_events_parts(spark, d).filter("event_type = 'error'").select(
        fc.indexed_name("event_id").alias("filename"), F.col("ts").alias("time"))
    table, work = scratch_path(spark, "cycle"), scratch_path(spark, "cycle-work")
    expected = en.pending(dt.items(spark, d)).select("filename").dropna().distinct().count()
    q = start_lifecycle(arrivals, table, scratch_path(spark, "cycle-ckpt"), work, SecondTry,
                        wait_s=1.0, trigger={"processingTime": "1 second"}, backoff_s=0.0)
    try:
        wait_described(q, spark, work, expected)
    finally:
        q.stop()  # the stream itself would go on for ever
    return tb.read_table(spark, table)


@register("stream_top_brands")
def q_stream_top_brands(spark, d):
    """Top ten brands of the item stream: candidates from a sketch of fixed size, counted exactly."""
    from binsight.session import scratch_path
    from binsight.streaming.top_stream import start_top, top_values
    out = scratch_path(spark, "top")
    q = start_top(prepare(dt.items_from(dt.stream_events_parts(spark, d))), "brand", out, scratch_path(spark, "top-ckpt"))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    top, _ = top_values(spark, out, prepare(dt.items(spark, d)), "brand")
    return top.withColumnRenamed("count", "total_waste_count")


@register("stream_ingest")
def q_stream_ingest(spark, d):
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    from binsight.streaming.ingest_stream import start_ingest
    arrivals = dt.stream_events_parts(spark, d).select(
        fc.indexed_name("event_id").alias("filename"), F.col("ts").alias("time"))
    table_path = scratch_path(spark, "items")
    q = start_ingest(arrivals, table_path, scratch_path(spark, "ingest-ckpt"), scratch_path(spark, "ingest-work"),
                     provider_factory=_provider_factory, backoff_s=0.0, partitioned=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return tb.read_table(spark, table_path)


ARRIVAL_FILES = 6


def _repeated_arrivals(spark, d) -> list[str]:
    """Folders of one file each that together hold every event's arrival, most of
    them twice or three times: again in the next file and in the last one."""
    from binsight.session import scratch_path
    ev = dt.table(spark, d, "events").select(fc.indexed_name("event_id").alias("filename"), F.col("ts").alias("time"))
    part = F.pmod(F.xxhash64("filename"), F.lit(ARRIVAL_FILES))
    paths = []
    for i in range(ARRIVAL_FILES):
        paths.append(scratch_path(spark, "arrivals"))
        again = (F.pmod(part + 1, F.lit(ARRIVAL_FILES)) == i) if i < ARRIVAL_FILES - 1 else part != i
        ev.filter((part == i) | again).coalesce(1).write.parquet(paths[-1])
    return paths


@register("stream_dedupe")
def q_stream_dedupe(spark, d):
    """Repeated arrivals, a file a trigger, with a restart half way: repeats go in the
    stream's state, those behind the watermark by the key table."""
    from binsight.session import scratch_path
    from binsight.sources import table as tb
    from binsight.streaming.ingest_stream import start_ingest
    files = _repeated_arrivals(spark, d)
    folder, table = scratch_path(spark, "arriving"), scratch_path(spark, "distinct")
    ckpt, work = scratch_path(spark, "distinct-ckpt"), scratch_path(spark, "distinct-work")
    for i, path in enumerate(files):
        spark.read.parquet(path).coalesce(1).write.mode("append").parquet(folder)
        if i % 3 < 2:
            continue
        arrivals = (spark.readStream.schema("filename string, time timestamp_ntz")
                    .option("maxFilesPerTrigger", 1).parquet(folder))
        q = start_ingest(arrivals, table, ckpt, work, distinct_within="1 day")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return tb.read_table(spark, table).select("filename", "time")
