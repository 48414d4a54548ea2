"""Image classification: pluggable scorer, label taxonomy, best label per image.

The scorer runs in ``mapInPandas`` and returns all labels of an image together,
so an image stays one row, ``key, [model,] scores array<struct<label, score>>``,
from the scorer to the report. Looking labels up in the fixed 46-row taxonomy
(a map literal), ranking and picking are array functions: no shuffle, no
window, and an image without any score keeps its row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight import constants as C
from binsight.functions.columns import capture_name, percent_text
from binsight.schema import SCORES, SCORES_BY_MODEL, TAXONOMY

_INSTANCES: dict = {}
_KNOWN = "array<struct<label:string,category:string,ordinal:int,score:double>>"


def taxonomy_rows(models: list[str] | None = None) -> list[tuple]:
    rows = []
    for model, (categories, mapping) in C.TAXONOMY.items():
        if models is not None and model not in models:
            continue
        for label, cat in mapping.items():
            rows.append((model, label, cat, categories.index(cat)))
    return rows


def check_model(model: str) -> str:
    if model not in C.TAXONOMY:
        raise ValueError(f"unknown model {model!r}; known: {sorted(C.TAXONOMY)}")
    return model


def taxonomy(spark: SparkSession, model: str | None = None) -> DataFrame:
    """(model, label, category, ordinal): 46 rows for all models, fixed by constants."""
    models = None if model is None else [check_model(model)]
    return spark.createDataFrame(taxonomy_rows(models), TAXONOMY)


def _lookup(model: str | None) -> Callable[[Column], Column]:
    """label -> struct(category, ordinal) or NULL; with ``model=None`` by the row's
    ``model`` column, where a model that the taxonomy does not know fails the job."""
    def of(name: str) -> Column:
        return F.create_map(*(x for _, label, cat, n in taxonomy_rows([name])
                              for x in (F.lit(label), F.struct(F.lit(cat).alias("category"), F.lit(n).alias("ordinal")))))

    if model is not None:
        table = of(check_model(model))
    else:
        unknown = F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(F.col("model"), F.lit("NULL"))))
        table = F.coalesce(*(F.when(F.col("model") == m, of(m)) for m in C.TAXONOMY),
                           unknown.cast("map<string,struct<category:string,ordinal:int>>"))
    return lambda label: F.element_at(table, label)


def _keys(model: str | None) -> list[str]:
    return ["key"] if model is not None else ["key", "model"]


def mapped(scores: DataFrame, model: str | None) -> DataFrame:
    """``scores`` with ``known``: the labels that the taxonomy maps, best first
    (score descending, then label)."""
    look = _lookup(model)
    # one lookup a label: the result is named before its fields are used
    found = F.transform("scores", lambda s: F.struct(s["label"].alias("label"), look(s["label"]).alias("to"), s["score"].alias("score")))
    known = F.transform(F.filter(found, lambda s: s["to"].isNotNull()), lambda s: F.struct(
        s["label"].alias("label"), s["to"]["category"].alias("category"), s["to"]["ordinal"].alias("ordinal"), s["score"].alias("score")))
    return scores.withColumn("known", F.coalesce(F.array_sort(known, _better), F.array().cast(_KNOWN)))


def _better(a: Column, b: Column) -> Column:
    """Descending score (NULL last), then ascending label."""
    x, y = F.coalesce(a["score"], F.lit(float("-inf"))), F.coalesce(b["score"], F.lit(float("-inf")))
    return (F.when(x > y, F.lit(-1)).when(x < y, F.lit(1)).when(a["label"] < b["label"], F.lit(-1))
            .when(a["label"] > b["label"], F.lit(1)).otherwise(F.lit(0)))


def label_lookup(scores: DataFrame, model: str | None) -> DataFrame:
    """Mapped labels only, a row each. ``model=None``: rows carry a ``model``
    column (several models in one run)."""
    return mapped(scores, model).select(*_keys(model), F.inline("known")).select(
        *_keys(model), "label", "category", "ordinal", "score")


def ranked_labels(scores: DataFrame, model: str | None) -> DataFrame:
    """All mapped labels per image (and model) with their rank (score desc, then label)."""
    return (mapped(scores, model).select(*_keys(model), F.posexplode("known").alias("pos", "k"))
            .select(*_keys(model), (F.col("pos") + 1).alias("rank"), "k.category", "k.label", "k.score"))


def top_label(scores: DataFrame, model: str | None) -> DataFrame:
    """Best mapped label per image (and model): rank 1 of ``ranked_labels``."""
    best = mapped(scores, model).filter(F.size("known") > 0).withColumn("b", F.get("known", F.lit(0)))
    return best.select(*_keys(model), F.lit(1).alias("rank"), "b.category", "b.label", "b.score")


def top_label_raw(scores: DataFrame, model: str, strict: bool = False) -> DataFrame:
    """Best raw label per image, then mapped; NULL category when unmapped
    (``strict`` raises instead, as a lookup of an unknown label would)."""
    best = F.get(F.array_sort("scores", _better), F.lit(0))
    out = scores.withColumn("b", best).filter(F.col("b").isNotNull()).select("key", "b.label", "b.score")
    cat = _lookup(model)(F.col("label"))["category"]
    if strict:
        cat = F.when(cat.isNull(), F.raise_error(F.concat(F.lit("unmapped label: "), F.col("label"))).cast("string")).otherwise(cat)
    return out.select("key", cat.alias("category"), "label", "score")


def best_per_image(scores: DataFrame, model: str | None) -> DataFrame:
    """Best mapped label of every image (and model); an image without a score or
    a mapped label keeps a row with NULL category, label and confidence."""
    best = mapped(scores, model).withColumn("b", F.get("known", F.lit(0)))
    return best.select(*_keys(model), "b.category", "b.label", F.col("b.score").alias("confidence"))


def classification_report(scores: DataFrame, images: DataFrame, model: str,
                          key: str = "filename", time_col: str = "time") -> DataFrame:
    """key, category, label, confidence, confidence_text, image_saved.

    ``images`` supplies the capture time per key (item table), collapsed to one
    row per key first (partial aggregate: a repeated key cannot multiply report
    rows or overload one task).
    """
    times = images.groupBy(F.col(key).alias("key")).agg(F.max(time_col).alias("__t"))
    return (best_per_image(scores, model).join(times, "key", "left")
            .select("key", "category", "label", "confidence",
                    percent_text("confidence").alias("confidence_text"),
                    capture_name("__t").alias("image_saved")))


# ---- pluggable scorer -------------------------------------------------------

def job_factory(factory: Callable) -> Callable:
    """Function that returns the job's one instance in each Python worker.

    Instances are kept under a token made here, on the driver, so another job's
    instance of the same class, function or name is never taken for this one's.
    """
    token = uuid.uuid4().hex

    def instance():
        if token not in _INSTANCES:
            _INSTANCES[token] = factory()
        return _INSTANCES[token]

    return instance


def score_images(images: DataFrame, scorer_factory: Callable, columns: list[str] | None = None,
                 several_models: bool = False, batch_rows: int = 256) -> DataFrame:
    """Run a scorer over image rows -> (key, [model,] scores): a row for every image.

    ``scorer_factory()`` builds the model once per Python worker and job; the
    scorer maps a pandas frame of at most ``batch_rows`` image rows (their bytes
    bound the call's memory) to a long frame ``key, [model,] label, score``.
    With ``several_models`` an image has a row for each model of the taxonomy,
    and one for any other model that the scorer names.
    """
    from binsight.session import ship_package
    ship_package(images.sparkSession)
    if columns:
        images = images.select(*columns)
    instance = job_factory(scorer_factory)
    models = list(C.TAXONOMY) if several_models else [None]

    def run(batches):
        import pandas as pd
        scorer = instance()
        for whole in batches:
            for at in range(0, len(whole), batch_rows):
                pdf = whole.iloc[at:at + batch_rows]
                long = scorer(pdf)
                found: dict = {}
                model = long["model"] if several_models else [None] * len(long)
                for k, m, label, s in zip(long["key"], model, long["label"], long["score"]):
                    found.setdefault(k, {}).setdefault(m, []).append({"label": label, "score": float(s)})
                rows = [(k, m, found.get(k, {}).get(m, [])) for k in pdf["key"]
                        for m in dict.fromkeys([*models, *found.get(k, {})])]
                out = pd.DataFrame(rows, columns=["key", "model", "scores"])
                yield out if several_models else out.drop(columns="model")

    return images.mapInPandas(run, SCORES_BY_MODEL if several_models else SCORES)


def classify_images(images: DataFrame, model: str | None, scorer_factory: Callable,
                    columns: list[str] | None = None) -> DataFrame:
    """key, category, label, confidence for every image; with ``model=None`` the
    scorer runs several models and returns a ``model`` column (one row per
    image and model)."""
    if model is not None:
        check_model(model)
    scores = score_images(images, scorer_factory, columns, several_models=model is None)
    return best_per_image(scores, model)


class ComponentScorer:
    """Deterministic stand-in model: label i scores the largest |component| of the
    embedding whose index is i modulo the number of labels."""

    def __init__(self, labels: list[str]):
        self.labels = list(labels)

    def __call__(self, pdf):
        import numpy as np
        import pandas as pd
        m = len(self.labels)
        rows = []
        for key, vector in zip(pdf["key"], pdf["embedding"]):
            v = np.abs(np.asarray(vector, dtype=np.float32).astype(np.float64))
            rows += [(key, label, v[i::m].max()) for i, label in enumerate(self.labels) if i < len(v)]
        return pd.DataFrame(rows, columns=["key", "label", "score"])
