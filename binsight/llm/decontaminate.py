"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

The index holds the test items and the training passages are the queries. Impacts
are BM25 weights divided by the score an item gives itself, so one threshold
holds for all items. Spark computes the statistics and impacts; the index is cut
into shards of a bounded number of words (an item that is longer is a shard of
its own), each broadcast on its own, and documents are matched where they lie,
without a shuffle. One shard at a time is in memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, normal_words, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of the item's score for itself
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 4  # items under one block maximum
SHARD_WORDS = 100_000  # words of the items in one broadcast shard, at most, but for a longer item

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_ANSWER = re.compile(r"(?i)(?:^|\n|\s)(?:answer|a)\s*:\s*")


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: cut at an answer mark, else before the last
    sentence, else (one sentence) before the last quarter of its words."""
    marked = list(_ANSWER.finditer(text))
    if marked:
        q, a = normal_words(text[:marked[-1].start()]), normal_words(text[marked[-1].end():])
        if q and a:
            return q, a
    parts = [w for s in _SENTENCE.split(text) if (w := normal_words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = normal_words(text)
    k = max(1, len(w) // 4)
    return w[:-k], w[-k:]


def holds(part: list[str], passage: list[str]) -> bool:
    """The words of ``part`` follow each other somewhere in the passage."""
    n = len(part)
    return any(passage[i:i + n] == part for i in range(len(passage) - n + 1))


def _grams(w: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(w)))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def overlap(part: list[str], passage: list[str], n: int = SHINGLE) -> float:
    """Share of the part's word n-grams (of all its words if it has fewer) in the passage; 1 for none."""
    grams = _grams(part, n)
    if not grams:
        return 1.0
    size = len(next(iter(grams)))
    return len(grams & {tuple(passage[i:i + size]) for i in range(len(passage) - size + 1)}) / len(grams)


class Index:
    """Inverted index of one shard: postings by item order, with term and block maxima."""

    def __init__(self, items: list[tuple[object, str]], postings: list[tuple[int, str, float]]):
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        # too few words for question and answer: the whole sequence has to be there
        self.short = {i: w for i, (_, t) in enumerate(items) if len(w := normal_words(t)) < SHINGLE}
        self.longest = max((len(q) + len(a) for q, a in self.parts), default=1)
        by_term: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for row, term, impact in postings:
            by_term[term].append((row, impact))
        self.vocabulary = {t: i for i, t in enumerate(sorted(by_term))}
        self.lists = [sorted(by_term[t]) for t in sorted(by_term)]
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.lists) + 1, max(1, self.blocks)), np.float32)  # last row: unknown words
        for i, plist in enumerate(self.lists):
            for row, impact in plist:
                b = row // BLOCK_ITEMS
                self.block_max[i, b] = max(self.block_max[i, b], impact)
        self.block_max = np.nextafter(self.block_max, np.float32(2))  # rounded up: bounds stay bounds
        self.block_max[-1] = 0
        self.term_max = self.block_max.max(1).astype(float)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of every item that scores the threshold or more."""
        lists = [self.lists[t] for t in terms]
        top = [float(self.term_max[t]) for t in terms]
        bmax = self.block_max[terms]
        at = [0] * len(terms)
        live = [i for i in range(len(terms)) if lists[i]]
        found = []
        end = len(self.ids)
        while live:
            live.sort(key=lambda i: lists[i][at[i]][0])
            # the pivot: before it, even all lists together stay below the threshold
            bound, pivot = 0.0, -1
            for n, i in enumerate(live):
                bound += top[i]
                if bound >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            ahead = live[:pivot + 1]
            if bmax[ahead, block].sum(dtype=float) < threshold:
                # no item of this block can reach it before another list joins in
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
                to = max(to, item + 1)
            elif lists[ahead[0]][at[ahead[0]]][0] == item:
                score = sum(lists[i][at[i]][1] for i in ahead)
                if score >= threshold:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for i in ahead:
                plist, k = lists[i], at[i]
                while k < len(plist) and plist[k][0] < to:
                    k += 1
                at[i] = k if to < end else len(plist)
            live = [i for i in live if at[i] < len(lists[i])]
        return found

    def matches(self, text: str | None, threshold: float, least: float) -> list[tuple]:
        """(item id, score, question overlap, answer overlap, first word) of verified items."""
        w = normal_words(text)
        if not w or not self.lists:
            return []
        none = len(self.lists)
        get = self.vocabulary.get
        ids = np.fromiter((get(x, none) for x in w), np.int32, len(w))
        # passages twice as long as the longest item, half overlapping: an item lies whole in one
        half = max(self.longest, 32)
        starts = np.arange(0, max(1, len(w) - half), half)
        ends = np.minimum(starts + 2 * half, len(w))
        # a word counts once a passage: where it stood before decides for either passage of its half
        order = np.argsort(ids, kind="stable")
        again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
        before = np.full(len(ids), -1)
        before[order[again + 1]] = order[again]
        own = np.arange(len(ids)) // half * half
        weight = self.term_max[ids]
        first = np.concatenate([[0.0], np.cumsum(weight * (before < own))])
        second = np.concatenate([[0.0], np.cumsum(weight * (before < own - half))])
        middle = np.minimum(starts + half, len(w))
        bound = first[middle] - first[starts] + second[ends] - second[middle]
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(bound >= threshold - 1e-9):
            a, b = int(starts[k]), int(ends[k])
            terms = ids[a:b][(before[a:b] < a) & (ids[a:b] < none)]
            if self.block_max[terms].sum(0, dtype=float).max() < threshold:
                continue
            for item, score in self.search(terms.tolist(), threshold):
                q, ans = self.parts[item]
                passage = w[max(0, a - half):b + half]
                if item in self.short and not holds(self.short[item], passage):
                    continue
                qo = overlap(q, passage)
                ao = overlap(ans, passage) if qo >= least else 0.0
                if qo >= least and ao >= least and (item not in best or score > best[item][1]):
                    best[item] = (self.ids[item], float(score), qo, ao, a)
        return [best[i] for i in sorted(best)]


def _items(bench: DataFrame, id_col: str, text_col: str, shard_words: int) -> DataFrame:
    """(row, item, text, n, shard) of the distinct items with words, stored. Shards are cut
    from running totals of words within hashed buckets, so none exceeds ``shard_words``
    but by its last item; a longer item has a shard of its own."""

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(normal_words(t)))

    items = (bench.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .distinct().withColumn("n", size("text")).filter("n > 0"))
    items = stored(items.withColumn("row", F.monotonically_increasing_id()), "benchmark")
    words = items.agg(F.sum("n")).first()[0] or 0
    small = F.col("n") <= shard_words // 2
    bucket = F.expr(f"pmod(xxhash64(row), {max(1, -(-words // (10 * shard_words)))})")
    before = F.sum("n").over(Window.partitionBy(bucket, small).orderBy("row")) - F.col("n")
    own = F.concat(F.lit("row "), F.col("row").cast("string"))
    part = F.concat_ws(" ", bucket.cast("string"), F.floor(before / (shard_words // 2 + 1)).cast("string"))
    return stored(items.withColumn("shard", F.when(small, part).otherwise(own)), "benchmark-shards")


def indexes(bench: DataFrame, id_col: str = "item_id", text_col: str = "text",
            shard_words: int = SHARD_WORDS) -> Iterator[Broadcast]:
    """The broadcast shards of the index, one after the other: a shard is made when
    it is asked for, so the driver holds two at most. All items with words are indexed,
    repeated ones once."""
    spark = bench.sparkSession

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(normal_words)

    items = _items(bench, id_col, text_col, shard_words)
    size = items.agg(F.count("*").alias("items"), F.sum("n").alias("words")).first()
    if not size["items"]:
        return
    each = items.select("row", "n", "shard", F.explode(terms("text")).alias("term")).groupBy("row", "n", "shard", "term").agg(
        F.count("*").alias("tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    mean = size["words"] / size["items"]
    impact = (F.log1p((size["items"] - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1)
              / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean)))
    weights = each.join(df, "term").select("row", "shard", "term", impact.alias("w"))
    own = weights.groupBy("row").agg(F.sum("w").alias("own"))
    weights = stored(weights.join(own, "row").select("row", "shard", "term", (F.col("w") / F.col("own")).alias("impact")), "impacts")
    for shard in sorted(r[0] for r in items.select("shard").distinct().collect()):
        rows = items.filter(F.col("shard") == shard).select("row", "item", "text").orderBy("row").collect()
        place = {r["row"]: i for i, r in enumerate(rows)}
        yield spark.sparkContext.broadcast(Index(
            [(r["item"], r["text"]) for r in rows],
            [(place[r["row"]], r["term"], r["impact"]) for r in weights.filter(F.col("shard") == shard).collect()]))


def matched(index: Broadcast, text: Column, item_type: str, threshold: float = THRESHOLD,
            least: float = OVERLAP) -> Column:
    """Array of the verified items of a shard in a text."""

    @F.pandas_udf(f"array<struct<item_id:{item_type},score:double,question_overlap:double,"
                  "answer_overlap:double,first_word:int>>")
    def run(texts: pd.Series) -> pd.Series:
        names = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")
        return texts.map(lambda t: [dict(zip(names, m)) for m in index.value.matches(t, threshold, least)])

    return run(text)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                  least: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): a row
    for each row of ``docs`` and test item that it holds.

    An item counts if some passage scores ``threshold`` or more of the item's
    own score and holds ``least`` or more of the word five-grams of its question
    and of its answer; an item of fewer than five words, if all of them follow each
    other there. A word is a run of letters or digits, or one character of a
    script without spaces. Null and empty texts and items without words match
    nothing; repeated documents are reported each; ids may be null; other
    columns are not looked at. Without items or documents there are no rows.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    found = docs.sparkSession.createDataFrame(
        [], f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, "
            "first_word int")
    before = None
    for index in indexes(bench, item_col, item_text_col):
        if before is not None:
            found = stored(found, "contamination")
            before.destroy()
        before = index
        found = found.union(docs.select(F.col(id_col).alias("doc_id"), F.explode(
            matched(index, F.col(text_col), item_kind, threshold, least)).alias("m")).select("doc_id", "m.*"))
    return found


def decontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows that hold a test item, all columns as they were.

    What holds an item is told by ``contamination``: null and empty texts stay, every
    copy of a row that holds one goes; ids may be null; columns of any name stay.
    """
    kind = bench.schema[item_col].dataType.simpleString()
    hit = free_name(docs, "hits")
    before = None
    for index in indexes(bench, item_col, item_text_col):
        if before is not None:
            docs = stored(docs, "decontaminated")  # one shard at a time in memory
            before.destroy()
        before = index
        docs = docs.withColumn(hit, matched(index, F.col(text_col), kind, threshold, least)).filter(
            F.size(hit) == 0).drop(hit)
    return docs
