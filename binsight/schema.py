"""Schemas of the item table, its inputs and the result tables."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM_COLUMNS = [
    "filename", "time", "state", "city", "description",
    "is_recyclable", "is_compostable", "is_metal", "brand",
]

ITEM = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("is_recyclable", T.BooleanType()),
    T.StructField("is_compostable", T.BooleanType()),
    T.StructField("is_metal", T.BooleanType()),
    T.StructField("brand", T.StringType()),
])

# JSON item feed: same fields, ``time`` arrives as ISO text without a zone.
ITEM_JSON = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == "time" else f.dataType) for f in ITEM.fields
])

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

METADATA_FIELDS = ["is_recyclable", "is_compostable", "is_metal", "brand", "description"]

# Parsed provider answer (one JSON object per image).
ANSWER = T.StructType([
    T.StructField("is_recyclable", T.BooleanType()),
    T.StructField("is_compostable", T.BooleanType()),
    T.StructField("is_metal", T.BooleanType()),
    T.StructField("brand", T.StringType()),
    T.StructField("description", T.StringType()),
])

METADATA = T.StructType([T.StructField("filename", T.StringType())] + ANSWER.fields)

# One row per image (and model): all labels with their scores.
SCORES = "key string, scores array<struct<label:string,score:double>>"
SCORES_BY_MODEL = "key string, model string, scores array<struct<label:string,score:double>>"

TAXONOMY = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
])
