"""Adapters that shape the shared test tables into the item model.

The test tables (``events``, ``part``, ``embeddings``, ``documents``,
``pages``) stand in for camera captures, provider answers and model scores:

* ``items``: one item per event; ``k`` (JSON path ``$.k`` of ``props``) picks
  the part that supplies description, brand and the metal keyword.
* ``scores``: six model outputs per embedding; label i scores the largest
  absolute component whose index is i modulo six, so all components count.
* ``answers`` / ``metadata``: provider answers for the pending items.
* ``paths``, ``iso_times``, ``payload``: inputs of the scalar operators.

Every adapter is lazy and covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight import constants as C

# FIXED VALUES: labels of the six score slots (``Unmapped`` is
# deliberately absent from every taxonomy).
SCORE_LABELS = ["Paper", "Other", "Plastic", "G_M", "Organic", "Unmapped"]
IMAGE_ROOT = "file:/data/images/"
METAL_PART_WORD = "anvil"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy reader of one test table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events joined to the part chosen by ``props.k``: event_id, ts, event_type, k, p_name, p_brand."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "event_type", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    joined = ev.join(part, ev.k == part.p_partkey, "inner")
    return joined.select("event_id", "ts", "event_type", "k", "p_name", "p_brand")


# SQL expressions of the nine item columns over an ``events_parts`` row.
ITEM_EXPRS = [
    "concat(CAST(event_id AS STRING), '.jpg') AS filename",
    "ts AS time",
    f"'{C.DEFAULT_STATE}' AS state",
    f"'{C.DEFAULT_CITY}' AS city",
    "CASE WHEN event_type = 'error' THEN '' ELSE p_name END AS description",
    "CASE WHEN event_type = 'error' THEN CAST(NULL AS BOOLEAN)"
    " ELSE event_type IN ('purchase', 'view') END AS is_recyclable",
    "CASE WHEN event_type = 'error' THEN CAST(NULL AS BOOLEAN)"
    " ELSE event_type IN ('signup', 'view') END AS is_compostable",
    f"CASE WHEN event_type = 'error' THEN CAST(NULL AS BOOLEAN) ELSE contains(p_name, '{METAL_PART_WORD}') END"
    " AS is_metal",
    "CASE WHEN event_type = 'error' OR pmod(k, 10) = 0 THEN ''"
    " WHEN pmod(k, 10) = 1 THEN CAST(NULL AS STRING) ELSE p_brand END AS brand",
]


def items_from(ep: DataFrame) -> DataFrame:
    return ep.selectExpr(*ITEM_EXPRS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table: nine columns, ``time`` kept as the source's TIMESTAMP_NTZ."""
    return items_from(events_parts(spark, sf_dir))


def known_and_listed(spark: SparkSession, sf_dir: str):
    """(existing, incoming): the items already described, and the whole folder as
    an ingest run lists it again."""
    ep = events_parts(spark, sf_dir)
    return items_from(ep.filter("event_type <> 'error'")), items_from(ep)


def _plain_answer() -> "F.Column":
    """A valid answer for an event row, but for a brand of the wrong form in some rows."""
    k, m = F.col("k"), F.pmod(F.col("event_id"), F.lit(150))
    text = F.when(F.pmod(k, F.lit(10)) == 0, F.lit("")).otherwise(F.col("p_brand"))
    brand = (F.when(m == 60, F.lit(', "brand": 5')).when(m == 70, F.lit(', "brand": {"x": 1}'))
             .when(m == 80, F.lit(', "brand": null')).when(m == 90, F.lit(""))
             .otherwise(F.concat(F.lit(', "brand": "'), text, F.lit('"'))))
    return F.concat(
        F.lit('{"is_recyclable": '), (F.pmod(k, F.lit(2)) == 0).cast("string"),
        F.lit(', "is_compostable": '), (F.pmod(k, F.lit(3)) == 0).cast("string"),
        F.lit(', "is_metal": '), F.col("p_name").contains(METAL_PART_WORD).cast("string"),
        brand, F.lit(', "description": "'), F.col("p_name"), F.lit('"}'))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, answer`` for every pending item (``description = ''``): valid ones,
    and by event_id modulo 150 each form that a provider gets wrong."""
    ep = events_parts(spark, sf_dir).filter(F.col("event_type") == "error")
    rows = ep.select("event_id", "p_name", _plain_answer().alias("good"))
    good, m = F.col("good"), F.pmod(F.col("event_id"), F.lit(150))
    wrong_type = F.concat(F.lit('{"is_recyclable": "yes", "is_compostable": false, "is_metal": false, '
                                '"brand": "", "description": "'), F.col("p_name"), F.lit('"}'))
    text = (F.when(m == 0, F.lit("Sorry, I cannot describe this image."))
            .when(m == 10, F.concat(good, F.lit(" Let me know if you need more.")))
            .when(m == 20, F.concat(good, good))
            .when(m == 30, F.concat(good, F.lit(", "), good))
            .when(m == 40, F.replace(good, F.lit('"'), F.lit("'")))
            .when(m == 50, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
            .when(m == 100, wrong_type)
            .when(m == 110, F.concat(F.lit("["), good, F.lit("]")))
            .when(m.isin(60, 70, 80, 90), good)
            .when(F.pmod(F.col("event_id"), F.lit(7)) == 0, F.concat(F.lit("  "), good, F.lit("\n")))
            .otherwise(good))
    return rows.select(F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("filename"), text.alias("answer"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image paths of all items plus page URLs (query strings, trailing segments)."""
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit(IMAGE_ROOT), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"))
    pg = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return ev.unionByName(pg)


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, time_text``: ISO text of ``ts``, junk in one row of 25."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    m = F.pmod(F.col("event_id"), F.lit(50))
    text = (F.when(m == 0, F.lit("not a time"))
             .when(m == 25, F.lit("2024-13-45T25:61:00"))
             .when(m == 10, F.lit(""))
             .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return ev.select("event_id", text.alias("time_text"))


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content``: document text as bytes, standing in for image files."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, embedding``: one 'image' per embedding row for the scorer."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("key"), "embedding")


def _slot(i: int, n: int) -> "F.Column":
    """Largest absolute component whose index is ``i`` modulo ``n``; NULL if there is none."""
    own = F.filter("embedding", lambda x, at: at % n == i)
    return F.array_max(F.transform(own, lambda x: F.abs(x.cast("double"))))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, scores``: the six labels with their slots' scores."""
    n = len(SCORE_LABELS)
    slots = [F.struct(F.lit(label).alias("label"), _slot(i, n).alias("score")) for i, label in enumerate(SCORE_LABELS)]
    return embedding_images(spark, sf_dir).select("key", F.array(*slots).alias("scores"))


def stream_events_parts(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``events``, one file or a folder of files, as an unbounded file source joined
    to the static ``part`` (stream-static join)."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    ev = reader.load(f"{sf_dir.rstrip('/')}/{{events}}.parquet").select(  # a pattern: a plain path has to be a folder
        "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    joined = ev.join(part, ev.k == part.p_partkey, "inner")
    return joined.select("event_id", "ts", "event_type", "k", "p_name", "p_brand")


def model_label_slots() -> list[tuple[str, str]]:
    """(model, label) per slot: every taxonomy label in model order, then one
    label no taxonomy maps."""
    slots = [(m, lbl) for m, (_cats, mapping) in C.TAXONOMY.items() for lbl in mapping]
    return slots + [("trash1", "Unmapped")]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, model, scores``: several models scored in one run, a row for each."""
    slots = model_label_slots()
    of = {}
    for i, (m, label) in enumerate(slots):
        of.setdefault(m, []).append(F.struct(F.lit(label).alias("label"), _slot(i, len(slots)).alias("score")))
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.array(*s).alias("scores")) for m, s in of.items()))
    return embedding_images(spark, sf_dir).select("key", F.inline(rows))
