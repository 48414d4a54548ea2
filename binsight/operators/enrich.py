"""Enrichment: ask a metadata provider about each pending image, parse the
answers, keep invalid ones aside with a reason, merge valid ones into the item table.

The provider is a pluggable callable run inside ``mapInPandas`` on the
executors (bounded retries, one instance per Python worker and job);
concurrency is the number of partitions of the pending set. Parsing is JVM-side.
"""

from __future__ import annotations

import time as _time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import request_document
from binsight.operators.classify import job_factory
from binsight.schema import ANSWER, METADATA_FIELDS

ANSWERS = "filename string, answer string, error string"
_WS = " \t\n\r"
_END = "end of the answer"  # written behind an answer, so that nothing may follow its object


class InvalidAnswerError(ValueError):
    pass


def pending(items: DataFrame) -> DataFrame:
    """Rows not enriched yet: description equal to '' (NULL is not pending)."""
    return items.filter(F.col("description") == C.PENDING_DESCRIPTION)


def with_request(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("request", request_document(content))


def call_provider(requests: DataFrame, provider_factory: Callable, retries: int = 3, backoff_s: float = 0.5,
                  strict: bool = False, batch_rows: int = 64) -> DataFrame:
    """(filename, request) -> (filename, answer, error), where the rows are: the
    requests, which hold whole images, are never shuffled.

    A call that fails ``retries`` times gives a NULL answer and the last error's
    text (rejected later), or raises when ``strict``. ``batch_rows`` bounds how
    many answers are held at a time. A provider's ``end_task()``, if it has one, is
    called when a task ends or fails.
    """
    from binsight.session import ship_package
    ship_package(requests.sparkSession)
    instance = job_factory(provider_factory)

    def answered(provider, batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for fn, req in zip(pdf["filename"], pdf["request"]):
                answer = error = None
                for attempt in range(retries):
                    try:
                        answer, error = provider(fn, req), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if attempt < retries - 1:
                            _time.sleep(backoff_s * (2 ** attempt))
                        elif strict:
                            raise
                out.append((fn, answer, error))
                if len(out) >= batch_rows:
                    yield pd.DataFrame(out, columns=["filename", "answer", "error"])
                    out = []
            yield pd.DataFrame(out, columns=["filename", "answer", "error"])

    def run(batches):
        provider = instance()
        try:
            yield from answered(provider, batches)
        finally:
            getattr(provider, "end_task", lambda: None)()

    return requests.select("filename", "request").mapInPandas(run, ANSWERS)


def parse_answers(answers: DataFrame, col: str = "answer") -> DataFrame:
    """filename, five metadata fields, is_valid, reason.

    Valid = the trimmed text is exactly one JSON object (nothing before or after
    it, strict quoting, no repeated key) that holds all five keys, each of its
    own type or null. A null is a value: it is merged like any other. Invalid
    rows get NULL fields and the first ``reason`` that applies.
    """
    text = F.btrim(F.col(col), F.lit(_WS))
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    at = lambda path, kind="variant": F.try_variant_get("__v", path, kind)
    whole = (F.coalesce(at("$[1]", "string") == _END, F.lit(False)) & at("$[2]").isNull()
             & F.schema_of_variant(at("$[0]")).startswith("OBJECT"))
    found = [whole.alias("__whole")]
    for f in ANSWER.fields:
        found += [F.schema_of_variant(at(f"$[0].{f.name}")).alias(f"__is_{f.name}"),
                  at(f"$[0].{f.name}", f.dataType.simpleString()).alias(f"__new_{f.name}")]
    # generated columns: a later filter on the outcome is not rewritten into a second parse
    df = answers.withColumn("__v", wrapped).select("*", F.inline(F.array(F.struct(*found))))
    reason = (F.when(F.col(col).isNull(), F.lit("no answer")).when(F.col("__v").isNull(), F.lit("not JSON"))
              .when(~F.col("__whole"), F.lit("not one object")))
    for f in ANSWER.fields:
        kind = F.col(f"__is_{f.name}")
        wanted = "BOOLEAN" if f.dataType.simpleString() == "boolean" else "STRING"
        reason = (reason.when(kind.isNull(), F.lit(f"no {f.name}"))
                  .when(~kind.isin(wanted, "VOID"), F.lit(f"{f.name} is not {wanted.lower()}")))
    valid = F.col("reason").isNull()
    error = ["error"] if "error" in answers.columns else []
    return df.withColumn("reason", reason).select(
        "filename", *(F.when(valid, F.col(f"__new_{f.name}")).alias(f.name) for f in ANSWER.fields),
        valid.alias("is_valid"), "reason", F.when(~valid, F.col(col)).alias("rejected_text"), *error)


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid metadata, rejects: filename, reason, text and, if asked, the call's error)."""
    ok = parsed.filter("is_valid").select("filename", *METADATA_FIELDS)
    error = [F.col("error")] if "error" in parsed.columns else []
    bad = parsed.filter(~F.col("is_valid")).select("filename", "reason", F.col("rejected_text").alias("answer"), *error)
    return ok, bad


def one_answer_per_file(ok: DataFrame) -> DataFrame:
    """One valid answer per file name (deterministic pick: the smallest answer).

    Runs on the small parsed answers, combined map-side, so the image bytes
    are never shuffled to remove duplicate requests.
    """
    best = F.min(F.struct(*METADATA_FIELDS)).alias("m")
    return ok.groupBy("filename").agg(best).select("filename", *[F.col(f"m.{f}").alias(f) for f in METADATA_FIELDS])


def ask(pending_rows: DataFrame, provider_factory: Callable, content: str = "content", **kw) -> DataFrame:
    """Parsed answers (see ``parse_answers``), one per row, asked on the
    partitions where the rows already are (no shuffle of the bytes).

    Lazy: every action on the result calls the provider again, so jobs store
    it in the shared folder first and work from the stored copy.
    """
    req = with_request(pending_rows.select("filename", content), content)
    return parse_answers(call_provider(req, provider_factory, **kw))


def split_answers(parsed: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid metadata, rejects); ``dedupe`` keeps one answer and one reject per file."""
    ok, bad = split_valid(parsed)
    if dedupe:
        ok, bad = one_answer_per_file(ok), bad.dropDuplicates(["filename"])
    return ok, bad


def raise_if_any(rejects: DataFrame) -> None:
    """``InvalidAnswerError`` for the first reject of a stored answer frame."""
    first = rejects.limit(1).collect()
    if first:
        raise InvalidAnswerError(f"{first[0]['filename']}: {first[0]['reason']}: {first[0]['answer']!r}")


def enrich(pending_rows: DataFrame, provider_factory: Callable, content: str = "content",
           dedupe: bool = True, **kw) -> tuple[DataFrame, DataFrame]:
    """(valid metadata, rejects) for pending rows carrying ``content`` bytes.

    The provider is asked once per row; with ``dedupe`` the answers are
    reduced to one per file name (pass False when the rows are unique by
    construction). Both frames are lazy (see ``ask``).
    """
    return split_answers(ask(pending_rows, provider_factory, content, **kw), dedupe)


class NumberedProvider:
    """Deterministic stand-in provider: answers from the number in the file name,
    malformed for one file in fifty."""

    def __call__(self, filename: str, request: str) -> str:
        n = int(filename.split(".", 1)[0])
        if n % 50 == 0:
            return "I cannot help with that."
        brand = "" if n % 4 == 0 else f"Brand#{n % 25 + 1}"
        return ('{"is_recyclable": %s, "is_compostable": %s, "is_metal": %s, "brand": "%s", '
                '"description": "item %d"}' % (str(n % 2 == 0).lower(), str(n % 3 == 0).lower(),
                                                str(n % 5 == 0).lower(), brand, n))
