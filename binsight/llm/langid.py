"""Language ID: nearest centroid over normalised TF-IDF character n-grams.

Texts become hashed counts of 1- to 3-grams of letters, weighted by inverse
document frequencies over all training texts. For each language a few centroids
come from spherical k-means over a bounded sample of its training rows; a text
takes the language of the nearest centroid by cosine. A text too far from all
centroids, for its length, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name

BUCKETS = 4096  # hashed n-grams
CLUSTERS = 4  # centroids of a language
SAMPLE = 600  # distinct training texts of a language that its centroids are fitted on, at most
LANGUAGES = 500  # languages a model may have; more raise ValueError
UNKNOWN = "und"
LEAST = 0.05  # cosine that any text needs
REJECT_AT = 8.0  # robust deviations below the median cosine of like lengths
_ROUNDS = 12
_PIECE = 1 << 18  # characters hashed at once
_LETTER = re.compile(r"[^\W\d_]")
_SHORT = 8  # classes below this hold under 128 n-grams
_LENGTHS = 24  # length classes: powers of two of the n-gram count


def counts(text: str | None) -> np.ndarray:
    """Hashed counts of the letter 1-, 2- and 3-grams of a whole text.

    Case is folded; every run of non-letters is one boundary. The text is taken
    in pieces that overlap by two characters, so no n-gram is lost.
    """
    out = np.zeros(BUCKETS, np.int64)
    if not text:
        return out
    tail, inside = np.zeros(0, np.uint64), True
    for at in range(0, len(text), _PIECE):
        low = text[at:at + _PIECE].lower()
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(code)
        code = np.where(letter, code, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= inside  # a boundary of two pieces is one boundary
        inside = bool(letter[-1])
        c = np.concatenate([tail, code[keep].astype(np.uint64)])
        new = len(tail)
        mix = c * np.uint64(0x9E3779B97F4A7C15)
        one = mix >> np.uint64(52)
        grams = [one[new:]]
        if len(c) > 1:
            two = (mix[1:] ^ (mix[:-1] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
            grams.append((two >> np.uint64(52))[max(0, new - 1):])
            if len(c) > 2:
                three = (two[1:] ^ (mix[:-2] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
                grams.append((three >> np.uint64(52))[max(0, new - 2):])
        for g in grams:
            out += np.bincount(g.astype(np.int64), minlength=BUCKETS)
        tail = c[-2:]
    return out


_LETTERS: np.ndarray | None = None


def _is_letter(code: np.ndarray) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        every = "".join(map(chr, range(0xD800))) + "퟿" * 0x800 + "".join(map(chr, range(0xE000, 0x30000)))
        table = np.zeros(0x30000, bool)
        table[[m.start() for m in _LETTER.finditer(every)]] = True
        table[0xD800:0xE000] = False
        _LETTERS = table
    return _LETTERS[np.minimum(code, len(_LETTERS) - 1)]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(-1, keepdims=True))
    return rows / np.maximum(norm, 1e-12)


def _vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF with logarithmic term frequency."""
    return _unit(np.log1p(count) * idf)


def length_class(count: np.ndarray) -> int:
    return min(_LENGTHS - 1, int(count.sum()).bit_length())


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]  # language of each centroid
    centroids: np.ndarray
    floor: np.ndarray  # least accepted cosine by length class

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine to its nearest centroid, rejected)."""
        if not text or not _LETTER.search(text) or not self.names:
            return UNKNOWN, 0.0, True
        count = counts(text)
        near = self.centroids @ _vector(count, self.idf)
        k = int(near.argmax())
        score = float(min(1.0, max(0.0, near[k])))
        return self.names[k], score, score < self.floor[length_class(count)]


def _spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids, started by farthest points from the mean direction; no random choice."""
    centres = [_unit(rows.mean(0))]
    while len(centres) < min(k, len(rows)):
        near = np.max(rows @ np.array(centres).T, axis=1)
        centres.append(rows[int(near.argmin())])
    c = np.array(centres)
    for _ in range(_ROUNDS):
        to = (rows @ c.T).argmax(1)
        c = np.array([_unit(rows[to == j].sum(0)) if (to == j).any() else c[j] for j in range(len(c))])
    return c


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
        clusters: int = CLUSTERS, languages: int = LANGUAGES) -> Model:
    """Model from the texts and languages of ``train``; null languages and texts
    without a letter teach nothing.

    Document frequencies cover every training row. The centroids of a language
    are fitted on at most ``sample`` distinct texts, taken in the order of a text hash.
    """
    rows = (train.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                df += counts(t) > 0
                n += 1
        yield pd.DataFrame({"bucket": np.arange(-1, BUCKETS), "n": np.concatenate([[n], df])})

    found = rows.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in found.collect():  # one row a bucket
        df[r["bucket"] + 1] = r["n"]
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1.0

    hashed = rows.withColumn("h", F.xxhash64("text"))
    distinct = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in distinct.limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    if not sizes:
        return Model(idf, [], np.zeros((0, BUCKETS)), np.full(_LENGTHS, LEAST))
    # a hash threshold keeps about twice the sample of each language before rows move
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * sample / n))))
    drawn = (hashed.filter((F.col("h") / (2.0 ** 64) + 0.5) <= share[F.col("lang")]).dropDuplicates(["lang", "h"])
             .withColumn("nr", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
             .filter(F.col("nr") <= sample).select("lang", "text"))

    def centres(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c = _spherical_kmeans(np.array([_vector(counts(t), idf) for t in pdf["text"]]), clusters).astype(np.float32)
        return pd.DataFrame({"lang": key[0], "nr": np.arange(len(c)), "centroid": list(c)})

    learned = drawn.groupBy("lang").applyInPandas(centres, "lang string, nr int, centroid array<float>")
    got = sorted(learned.collect(), key=lambda r: (r["lang"], r["nr"]))
    model = Model(idf, [r["lang"] for r in got], np.array([r["centroid"] for r in got]), np.zeros(_LENGTHS))
    shared = train.sparkSession.sparkContext.broadcast(model)

    def nearness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for lang, t in zip(pdf["lang"], pdf["text"]) for x in _nearness(shared.value, lang, t)],
                               columns=["length", "whole", "own", "other"])

    near = drawn.mapInPandas(nearness, "length int, whole boolean, own double, other double").toPandas()
    model.floor = _floors(*(near[c].to_numpy() for c in near))
    return model


def _nearness(model: Model, lang: str, text: str) -> Iterator[tuple[int, bool, float, float]]:
    """(length class, is it whole, cosine to the own and to other languages, NaN
    without others) of a text and of its beginnings, about one for each shorter class."""
    names = np.array(model.names)
    count = counts(text)
    whole = length_class(count)
    for k in range(min(whole, _SHORT), whole + 1):
        if k < whole:  # a letter or boundary makes three n-grams
            part = counts(text[:(1 << k) // 4])
        else:
            part = count
        cos = model.centroids @ _vector(part, model.idf)
        other = cos[names != lang]
        yield length_class(part), k == whole, float(cos[names == lang].max()), float(other.max()) if len(other) else np.nan


def _floors(length: np.ndarray, whole: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Least accepted cosine by length class. It is far below what the sample's texts
    of like length (the class and its neighbours) reach, and where they spread
    widely or are few, what texts reach in a language that is not theirs, but at
    most half of what they reach in their own (two fifths, if there is one language).
    Beginnings of longer texts speak for a class without texts, the longest class
    seen for longer ones. A text of a few words is only rejected if it has next to
    nothing in common."""
    floor = np.full(_LENGTHS, LEAST)
    for k in range(_SHORT, _LENGTHS):
        at = np.abs(length - k) <= 1
        if at.any():
            mid = np.median(own[at])
            wrong = other[at & ~np.isnan(other)]
            floor[k] = max(LEAST, min(np.median(wrong), mid / 2) if len(wrong) else 0.4 * mid)
        else:
            floor[k] = floor[k - 1]
        near = own[at & whole]
        if len(near) >= 8:
            mid = np.median(near)
            spread = max(1.4826 * np.median(np.abs(near - mid)), 0.02)
            floor[k] = max(floor[k], mid - REJECT_AT * spread)
    return floor


def prediction(model: Model, df: DataFrame, text: Column) -> Column:
    """struct(lang, score, rejected) of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES * CLUSTERS centroids

    @F.pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return run(text)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **settings) -> DataFrame:
    """(doc_id, lang_pred, score, rejected): a row for each row of ``docs``.

    ``lang_pred`` is a language of ``train``, or ``und`` (score 0, rejected) for a
    null text, a text without a letter, or when nothing was learned. ``score`` is
    the cosine to the nearest centroid, cut to 0..1. Repeated rows and null ids
    are answered each; other columns are not looked at.
    """
    model = fit(train, text_col, lang_col, **settings)
    return docs.select(F.col(id_col).alias("doc_id"), prediction(model, docs, F.col(text_col)).alias("p")).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def accepted(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """``docs`` without the rows whose text is rejected, all columns as they were."""
    model = fit(train, text_col, lang_col, **settings)
    p = free_name(docs, "prediction")
    return docs.withColumn(p, prediction(model, docs, F.col(text_col))).filter(~F.col(p)["rejected"]).drop(p)
