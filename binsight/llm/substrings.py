"""Removal of word windows that repeat anywhere, by level-wise doubling.

Level lengths double up to the window (for 35: 9, 18, 35). A window is looked at
on a level only if its part on the level before is repeated:

1. Every window is represented by its smallest 9-gram (leftmost of equals), so
   equal windows share it. Consecutive windows with one representative form a
   run; runs are counted by it.
2. Runs whose 9-gram is repeated are extended to the 18-gram that goes on to the
   right of it, or to the left where the window ends too early, and counted.
3. Runs whose 18-gram is repeated are compared whole: equal runs are repeated
   windows. Of each different run under one 18-gram, one row's windows are hashed
   and counted on their own.

The levels end early when no candidate is left. Counts are keyed aggregates and
joins over stored tables; nothing is collected. All counts tell texts apart by
128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, words

WINDOW = 35
_BASES = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD6E8FEB86659FD93))  # odd: invertible modulo 2^64


def levels(window: int) -> list[int]:
    """Lengths of the levels: about a quarter, doubled, doubled and cut to the window."""
    out = [-(-window // 4)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


@lru_cache(maxsize=4)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASES[lane])
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Text:
    """Hashes of the spans of one text's words, in two independent lanes."""

    def __init__(self, text: str | None):
        w = words(text)
        self.n = len(w)
        each = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, w)), "<u8").reshape(-1, 2)
        size = 1 << max(10, self.n.bit_length())
        self._down = [_powers(lane, size)[1] for lane in (0, 1)]
        self._sums = [np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(each[:, lane] * _powers(lane, size)[0][:self.n])])
                      for lane in (0, 1)]

    def spans(self, start: np.ndarray, length: np.ndarray | int, lane: int) -> np.ndarray:
        s = self._sums[lane]
        return _mix((s[start + length] - s[start]) * self._down[lane][start] + np.uint64(lane + 1))

    def runs(self, window: int) -> tuple[np.ndarray, ...] | None:
        """(first window, windows, side, 9-gram hash, 18-gram hash, run hash) of the runs, or None."""
        n = self.n - window + 1
        if n < 1:
            return None
        small, double = levels(window)[0], min(window, 2 * levels(window)[0])
        grams = self.spans(np.arange(self.n - small + 1), small, 0)
        seen = window - small + 1
        pick = np.lib.stride_tricks.sliding_window_view(grams, seen).argmin(1)
        at = np.arange(n) + pick
        side = (pick > window - double).astype(np.int64)  # 1: extended to the left
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (side[1:] != side[:-1])]))
        count = np.diff(np.append(new, n))
        p, sd = at[new], side[new]
        wide = self.spans(np.where(sd == 1, p + small - double, p), double, 0)
        whole = self.spans(new, count + window - 1, 1)
        whole = _mix(whole ^ (pick[new].astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)))
        return new, count, sd, grams[p], wide, whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keyed(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    """Two hashes that stand for a row's text, and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("k2"),
                       text.alias("text"), *others)


def _runs(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            rows, size = [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = Text(text).runs(window)
                if found is None:
                    continue
                first, count, side, small, wide, whole = found
                rows.append(np.full(len(first), i))
                for o, x in zip(out, (first, count, side, small, wide, whole)):
                    o.append(x)
                size += len(first)
                if size > 200_000:
                    yield made(k1, k2, rows, out)
                    out, rows, size = [[] for _ in range(6)], [], 0
            if rows:
                yield made(k1, k2, rows, out)

    def made(k1, k2, rows, out) -> pa.RecordBatch:
        at = np.concatenate(rows)
        first, count, side, small, wide, whole = (np.concatenate(o) for o in out)
        # the side is part of the small hash: windows that extend differently do not meet
        small = _mix(small + side.astype(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[at]), pa.array(k2[at]), _signed(small), _signed(wide), _signed(whole),
             pa.array(first * 64 + count)], names=["k1", "k2", "small", "wide", "whole", "place"])

    if window - levels(window)[0] + 1 > 63:
        raise ValueError("windows of at most 80 words")
    return keyed.select("k1", "k2", "text").mapInArrow(
        run, "k1 long, k2 long, small long, wide long, whole long, place long")


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(k1, k2, first, count): windows number ``first`` to ``first + count - 1`` of
    the text with keys k1, k2 also start elsewhere in the texts of ``docs``."""
    keyed = _keyed(docs, text_col)
    none = docs.sparkSession.createDataFrame([], "k1 long, k2 long, first long, count long")
    runs = _runs(keyed, window)
    # level 1: the smallest part
    again = stored(runs.groupBy("small").agg(F.count("*").alias("n")).filter("n > 1").select("small"), "level-1")
    left = stored(runs.join(again, "small", "left_semi"), "runs-1")
    # level 2: twice as long
    again = stored(left.groupBy("small", "wide").agg(F.count("*").alias("n")).filter("n > 1").select("small", "wide"),
                   "level-2")
    if again.isEmpty():
        return none
    left = stored(left.join(again, ["small", "wide"], "left_semi"), "runs-2")
    # level 3: whole runs, then the windows of runs that differ
    kinds = stored(left.groupBy("small", "wide", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one")), "runs-3")
    # the count is over joined rows: a run that is there twice is repeated as a whole
    equal = left.join(kinds.filter("n > 1").select("small", "wide", "whole"), ["small", "wide", "whole"], "left_semi")
    mixed = stored(kinds.groupBy("small", "wide").agg(F.count("*").alias("n")).filter("n > 1").select("small", "wide"),
                   "mixed")
    asked = (kinds.join(mixed, ["small", "wide"], "left_semi")
             .select("one.k1", "one.k2", F.struct(F.xxhash64("small", "wide").alias("group"), F.col("one.place").alias("place"))
                     .alias("run"))
             .groupBy("k1", "k2").agg(F.collect_list("run").alias("runs")))  # at most the runs of a text
    asked = stored(asked, "asked")
    hashed = stored(keyed.join(asked, ["k1", "k2"]).mapInArrow(
        _window_hashes(window), "k1 long, k2 long, group long, hash long, at long"), "windows")
    # equal texts may have come in several tasks: the same place twice is no repetition
    place = F.struct("k1", "k2", "at")
    twice = stored(hashed.groupBy("group", "hash").agg(F.min(place).alias("a"), F.max(place).alias("b"))
                   .filter("a <> b").select("group", "hash"), "level-3")
    single = hashed.join(twice, ["group", "hash"], "left_semi")
    return (equal.select("k1", "k2", F.expr("place div 64").alias("first"), F.expr("place % 64").alias("count"))
            .union(single.select("k1", "k2", F.col("at").alias("first"), F.lit(1).cast("long").alias("count"))).distinct())


def _window_hashes(window: int):
    """Partition function: the windows of each asked run, once for equal texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for i, (k1, k2) in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                t, runs = Text(batch.column("text")[i].as_py()), batch.column("runs")[i].as_py()
                first = np.array([r["place"] // 64 for r in runs])
                count = np.array([r["place"] % 64 for r in runs])
                group = np.repeat(np.array([r["group"] for r in runs], np.int64), count)
                at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2)), pa.array(group),
                     _signed(t.spans(at, window, 1)), pa.array(at)], names=["k1", "k2", "group", "hash", "at"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of ``docs`` without the words
    of windows that also start elsewhere, the same text included.

    Words are runs of bytes without white space, unchanged, joined by one space
    in ``kept``. Null, empty and shorter texts lose nothing; all windows of a
    repeated row are repeated. Ids may be null or repeat; other columns are not
    looked at; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = stored(repeated_spans(docs, text_col, window).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("first", "count")).alias("spans")), "spans")  # at most the windows of a text
    rows = _keyed(docs.withColumnRenamed(id_col, free := free_name(docs, "the_id")), text_col, free)
    rows = rows.join(spans, ["k1", "k2"], "left").select(F.col(free).alias("doc_id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                w = words(text)
                n.append(len(w))
                if found:
                    change = np.zeros(len(w) + 1, np.int64)
                    np.add.at(change, [s["first"] for s in found], 1)
                    np.add.at(change, [s["first"] + s["count"] - 1 + window for s in found], -1)
                    keep = np.cumsum(change[:-1]) == 0
                    removed.append(len(w) - int(keep.sum()))
                    w = [w[i] for i in np.flatnonzero(keep)]
                else:
                    removed.append(0)
                kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
