"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage of a whole text is encoded from
its characters and words; gated attention weighs the passages, and the weighted
representation is scored. The network is trained on document labels over a
bounded sample; all documents are then scored where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

PASSAGE_WORDS = 64
TRAIN_ROWS = 4000  # labelled documents the network is trained on, at most
TRAIN_PASSAGES = 100_000  # their passages, at most: the sample ends, in hash order, where they are reached
TRAIN_LONGEST = 5_000  # passages of a document to learn from, at most; longer ones are only scored
HIDDEN = 32
GATE = 16
EPOCHS = 30
_BATCH = 128
_CLASSES = 8
_BAG = 64
_STATS = 7
DIMS = _CLASSES + _CLASSES * _CLASSES + _BAG + _STATS
_SEED = 7

_CLASS_OF: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Class of every code point: 0 lower, 1 upper, 2 digit, 3 space, 4 line end,
    5 sentence mark, 6 other mark, 7 letter of no case."""
    global _CLASS_OF
    if _CLASS_OF is None:
        table = np.full(0x30001, 6, np.uint8)
        for c in range(0x30000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.islower():
                table[c] = 0
            elif ch.isupper():
                table[c] = 1
            elif ch.isdigit():
                table[c] = 2
            elif ch.isalpha():
                table[c] = 7
        table[[ord(" "), 9, 11, 12]] = 3
        table[[10, 13]] = 4
        table[[ord(c) for c in ".,;:?'\"()-"]] = 5
        _CLASS_OF = table
    return _CLASS_OF


_R = np.random.default_rng(_SEED).integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)


def encode(text: str | None, passage_words: int = PASSAGE_WORDS) -> np.ndarray:
    """A row of ``DIMS`` features for every passage of a whole text; a text
    without words is one row of zeros."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _class_table()[np.minimum(code, 0x30000)]
    word = (kind != 3) & (kind != 4)
    begin = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]])) if len(code) else np.zeros(0, int)
    if not len(begin):
        return np.zeros((1, DIMS), np.float32)
    n = -(-len(begin) // passage_words)
    first = begin[::passage_words].copy()
    first[0] = 0
    chars = np.diff(np.append(first, len(code)))
    of = np.repeat(np.arange(n), chars)
    k = kind.astype(np.int64)
    one = np.bincount(of * _CLASSES + k, minlength=n * _CLASSES).reshape(n, -1)
    pair = of * (_CLASSES * _CLASSES) + k * _CLASSES
    pair[:-1] += k[1:]
    two = np.bincount(pair, minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
    # words: a hash of each from its characters and their places
    run = np.maximum.accumulate(np.where(word & np.concatenate([[True], ~word[:-1]]), np.arange(len(code)), 0))
    lower = np.where(kind == 1, code | 32, code).astype(np.uint64)
    mixed = np.where(word, (lower + np.uint64(1)) * _R[(np.arange(len(code)) - run) & 63], np.uint64(0))
    h = np.add.reduceat(mixed, begin)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    length = np.add.reduceat(word.astype(np.int64), begin)
    at = np.arange(len(begin)) // passage_words
    words = np.bincount(at, minlength=n)
    order = np.lexsort((h, at))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])
    distinct = np.bincount(at[order][new], minlength=n)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    mean = np.bincount(at, length, n) / words
    spread = np.sqrt(np.maximum(0, np.bincount(at, length.astype(float) ** 2, n) / words - mean ** 2))
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(at * _BAG + (h >> np.uint64(58)).astype(np.int64), sign, n * _BAG).reshape(n, -1)
    c = chars[:, None]
    stats = np.stack([distinct / words, np.bincount(at, again, n) / words, mean / 10, spread / 10,
                      np.log1p(words) / 5, chars / words / 10, np.full(n, np.log1p(n) / 10)], 1)
    return np.concatenate([one / c, two / c, bag / np.sqrt(words)[:, None], stats], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All activations of bags whose passages are consecutive rows of ``x``."""
        w = self.weights
        size = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, g = np.tanh(h @ w["tan"]), _sigmoid(h @ w["gate"])
        s = (t * g) @ w["att"]
        top = np.repeat(np.maximum.reduceat(s, starts), size)
        e = np.exp(s - top)
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts)
        p = _sigmoid(z @ w["out"] + w["out_b"])
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "size": size}

    def score(self, text: str | None) -> float:
        x = (encode(text) - self.mean) / self.scale
        return float(self.forward(x, np.zeros(1, int))["p"][0])


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam on the log loss of the bags; same bags, same network. Without bags
    the network scores one half everywhere."""
    rng = np.random.default_rng(_SEED)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"enc": draw(DIMS, HIDDEN), "enc_b": np.zeros(HIDDEN), "tan": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE),
         "att": draw(GATE), "out": np.zeros(HIDDEN), "out_b": np.zeros(1)}
    if not bags:
        return Model(np.zeros(DIMS), np.ones(DIMS), w)
    every = np.concatenate(bags)
    model = Model(every.mean(0), np.maximum(every.std(0), 1e-3), w)
    bags = [(b - model.mean) / model.scale for b in bags]
    base = np.clip(labels.mean(), 0.01, 0.99)
    w["out_b"][:] = np.log(base / (1 - base))
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), _BATCH):
            pick = order[at:at + _BATCH]
            x = np.concatenate([bags[i] for i in pick])
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]])
            f = model.forward(x, starts)
            d_out = (f["p"] - labels[pick]) / len(pick)
            grad = {"out": f["z"].T @ d_out, "out_b": d_out.sum(keepdims=True)}
            d_z = np.repeat(d_out[:, None] * w["out"], f["size"], axis=0)
            d_a = (d_z * f["h"]).sum(1)
            inner = np.repeat(np.add.reduceat(d_a * f["a"], starts), f["size"])
            d_s = f["a"] * (d_a - inner)
            d_h = d_z * f["a"][:, None]
            grad["att"] = (f["t"] * f["g"]).T @ d_s
            d_tg = d_s[:, None] * w["att"]
            d_t = d_tg * f["g"] * (1 - f["t"] ** 2)
            d_g = d_tg * f["t"] * f["g"] * (1 - f["g"])
            grad["tan"], grad["gate"] = f["h"].T @ d_t, f["h"].T @ d_g
            d_h += d_t @ w["tan"].T + d_g @ w["gate"].T
            d_e = d_h * (1 - f["h"] ** 2)
            grad["enc"], grad["enc_b"] = x.T @ d_e, d_e.sum(0)
            step += 1
            for k, gr in grad.items():
                gr = gr + (1e-4 * w[k] if w[k].ndim > 1 else 0)
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                w[k] -= 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> Model:
    """Network trained on at most ``rows`` labels, taken in the order of an id
    hash, until their documents have ``passages`` passages; a document of more than
    ``TRAIN_LONGEST`` passages teaches nothing. The sample depends on the rows alone.
    Null ids and labels teach nothing; a label of 1 or more is 1; repeated
    documents count once."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) >= 1).cast("int").alias("label"))
    known = known.dropna().distinct().orderBy(F.xxhash64("id", "label")).limit(rows)

    @F.pandas_udf("struct<n:int,x:array<float>>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        made = [encode(t) for t in texts]
        return pd.DataFrame({"n": [len(x) for x in made], "x": [x.ravel() for x in made]})

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: -(-len((t or "").split()) // PASSAGE_WORDS))

    found = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(known), "id")  # at most ``rows`` pairs
             .withColumn("key", F.xxhash64("id", "text")).dropDuplicates(["key", "label"]))
    found = found.withColumn("size", F.greatest(size("text"), F.lit(1))).filter(F.col("size") <= TRAIN_LONGEST)
    found = stored(found.select("key", "label", "size", "text"), "labelled")
    # one task adds up the sizes of at most ``rows`` documents, without their texts
    total = F.sum("size").over(Window.orderBy("key", "label").rowsBetween(Window.unboundedPreceding, 0))
    chosen = found.select("key", "label", total.alias("total")).filter(F.col("total") <= passages).drop("total")
    sample = found.join(F.broadcast(chosen), ["key", "label"]).select("label", encoded("text").alias("e")).select("label", "e.n", "e.x")
    bags: list[np.ndarray] = []
    y: list[int] = []
    for r in sample.toLocalIterator():
        bags.append(np.array(r["x"], np.float32).reshape(r["n"], DIMS))
        y.append(r["label"])
    order = sorted(range(len(bags)), key=lambda i: (bags[i].shape[0], bags[i].tobytes()))
    return train([bags[i] for i in order], np.array([y[i] for i in order], float))


def scored(model: Model, df: DataFrame, text: Column) -> Column:
    """Probability of label 1 for a text column; nulls are empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a network of fixed size

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return run(text)


def quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", **settings) -> DataFrame:
    """(doc_id, score, predicted): a row for each row of ``docs``.

    Null and empty texts are scored as a bag of one empty passage; repeated rows
    and null ids are scored each; other columns are not looked at.
    """
    model = fit(train_docs, labels, id_col, text_col, label_col, **settings)
    return docs.select(F.col(id_col).alias("doc_id"), scored(model, docs, F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
