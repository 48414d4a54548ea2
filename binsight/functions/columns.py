"""Scalar column expressions of the item model.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``, so
it stays inside whole-stage codegen; nothing calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from binsight import constants as C


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    """Last ``/``-separated segment of a path or URL ('' after a trailing slash)."""
    return F.element_at(F.split(_c(path), "/"), -1)


def hour_of_day(ts) -> Column:
    """Hour 0-23 in the session time zone (pinned to UTC by ``get_session``)."""
    return F.hour(_c(ts))


def parse_time(text, fmt: str | None = None, strict: bool = False, zoned: bool = True) -> Column:
    """ISO text -> timestamp.

    ``strict`` raises on malformed text (ANSI cast); the lenient default gives
    NULL, which is what the item feed tolerated. ``zoned=False`` keeps the wall
    clock as TIMESTAMP_NTZ, independent of the session time zone.
    """
    col = _c(text)
    if fmt is not None:
        if zoned:
            return F.to_timestamp(col, F.lit(fmt)) if strict else F.try_to_timestamp(col, F.lit(fmt))
        return F.to_timestamp_ntz(col, F.lit(fmt)) if strict else F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")
    target = "timestamp" if zoned else "timestamp_ntz"
    return col.cast(target) if strict else col.try_cast(target)


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def capture_name(ts, folder: str = "images", prefix: str = "capture_", suffix=None) -> Column:
    """``images/capture_yyyyMMdd-HHmmss.jpg``; ``suffix`` (a column) avoids same-second clashes."""
    parts = [F.lit(f"{folder}/{prefix}"), F.date_format(_c(ts), "yyyyMMdd-HHmmss")]
    if suffix is not None:
        parts += [F.lit("-"), _c(suffix).cast("string")]
    parts.append(F.lit(".jpg"))
    return F.concat(*parts)


def indexed_name(idx, ext: str = ".jpg") -> Column:
    return F.concat(_c(idx).cast("string"), F.lit(ext))


def percent_text(fraction, decimals: int = 2) -> Column:
    """``0.1234 -> '12.34%'`` (Java rounding: exact halves go up)."""
    return F.format_string(f"%.{decimals}f%%", _c(fraction) * 100)


def recode(col, mapping: dict) -> Column:
    """Dictionary recode; values without an entry become NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), _c(col)) if mapping else F.lit(None)


def total_label(count) -> Column:
    return F.concat(F.lit("Total: "), _c(count).cast("string"))


def last_dotted(name) -> Column:
    """Last ``.``-separated segment: ``'Disposable.RECYCLE' -> 'RECYCLE'``."""
    return F.element_at(F.split(_c(name), r"\."), -1)


def base64_text(content) -> Column:
    """Unbroken base64 of a binary column (Spark may insert CRLF every 76 chars)."""
    return F.replace(F.base64(_c(content)), F.lit("\r\n"), F.lit(""))


def request_document(content, prompt: str = C.METADATA_PROMPT, model: str = C.METADATA_MODEL,
                     mime: str = C.IMAGE_MIME) -> Column:
    """Chat request JSON carrying the prompt and the image as a data URI.

    Text and image parts share one struct type; ``to_json`` drops the NULL
    fields, so each part serialises with only its own keys.
    """
    part = "struct<type:string,text:string,image_url:struct<url:string>>"
    text_part = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"),
                         F.lit(None).cast("struct<url:string>").alias("image_url")).cast(part)
    url = F.concat(F.lit(f"data:{mime};base64,"), base64_text(content))
    image_part = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                          F.struct(url.alias("url")).alias("image_url")).cast(part)
    message = F.struct(F.lit("user").alias("role"), F.array(text_part, image_part).alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message).alias("messages")))
