"""Phrase collocations from stripes: each prefix keys a counter of the words after it.

Level by level, for prefixes of 0, 1, 2 and 3 words, every task counts its part
of the texts into stripes (prefix -> next words and their counts) and Spark
merges equal prefixes elementwise. A level counts only what can still reach the
least frequency: a phrase cannot occur more often than the phrases inside it, so
a prefix and a next word are counted only where the level before found both
(prefix, and its tail with the next word) frequent. That is looked up in a
bitmap of a fixed size with one-sided errors: a wrong hit costs a few bytes,
nothing frequent is ever missed.

The merged stripes hold everything that a score needs: entries are the
frequencies of phrases, which are also the totals of the prefixes one level on,
and so of first parts and rests; maxima (by prefix, and by the tail of the
prefix with the next word) tell which longer phrases cover a phrase.

Stripes are split by a hash of the next word: that of the empty prefix, and those
of the prefixes, at most ``HEAVY`` for each length, that occur too often for one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEAST = 30  # occurrences of a candidate
WORDS = 4  # of the longest phrase
COVERED = 80  # percent of a phrase's occurrences inside a longer one
TOP = 2000
BITS = 1 << 27  # of a level's bitmap: 16 MB
HEAVY = 4096  # a stripe is only split if its prefix makes up this part of all words
SHARE = 5_000_000  # occurrences of a split stripe's prefix for each part
ROOT_PARTS = 1024  # of the empty prefix's stripe
CHUNK = 1_500_000  # words counted at once
SLICE = 1 << 20  # bytes of a long text taken at once
_BUCKET = 4096 * 8  # bits in a row of Spark's bitmap aggregate

_BREAK = b"\xff"  # in no UTF-8 text
_CLEAN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b-\r]")
# a stripe of a chunk: its next words joined by spaces, their counts as 64-bit integers in a row
_STRIPE = "lang string, prefix string, part int, next string, count binary"
_SCHEMA = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()),
                     ("next", pa.string()), ("count", pa.binary())])


def _slices(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """(words and breaks, is the last) of a lower-cased text, a bounded number at once."""
    at, size = 0, len(text)
    while True:
        gap = _GAP.search(text, at + SLICE) if at + SLICE < size else None
        end = gap.start() if gap else size
        yield text[at:end].translate(_CLEAN).replace(_BREAK, b" \xff ").split(), gap is None
        if gap is None:
            return
        at = end


def _rotated(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(7)) | (h >> np.uint64(57))


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Both bits of each hash are set."""
    out = np.ones(len(h), bool)
    for x in (h, h >> np.uint64(32)):
        x = x & np.uint64(BITS - 1)
        out &= (bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _stripes_of(tokens: pa.Array, lang: str, size: int, bitmap, heavy: dict[int, int]) -> pa.RecordBatch | None:
    """Stripes of the prefixes of ``size`` words in one chunk; prefixes within its last ``size``
    words are left to the next chunk, which begins with these words if the text goes on.
    ``heavy`` has the number of parts of split stripes by the prefix's hash."""
    coded = tokens.dictionary_encode()
    ids, vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    v = len(vocab)
    pause = pc.index(vocab, pa.scalar(_BREAK, vocab.type)).as_py()
    word = ids != pause
    hashed = np.array([xxhash.xxh64_intdigest(w, 42) for w in vocab.to_pylist()], np.uint64)
    texts = pc.if_else(pc.equal(pa.array(np.arange(v)), pause), pa.scalar(b"", vocab.type), vocab).cast(pa.string())
    if size == 0:
        count = np.bincount(ids[word], minlength=v)
        nxt = np.flatnonzero(count)
        if not len(nxt):
            return None
        count, prefix, first = count[nxt], np.zeros(len(nxt), np.int64), np.zeros(1, np.int64)
        part = (hashed[nxt] % np.uint64(ROOT_PARTS)).astype(np.int64)
        names = pa.array([""], pa.string())
    else:
        n = len(ids) - size + 1
        if n < 2:
            return None
        h = np.full(n, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42), np.uint64)
        whole = np.ones(n, bool)
        for k in range(size):
            h = _rotated(h) ^ hashed[ids[k:k + n]]
            whole &= word[k:k + n]
        at = np.flatnonzero(whole)
        known = np.zeros(n, bool)
        known[at[_in(bitmap, h[at])]] = True
        start = np.flatnonzero(known[:-1] & known[1:])  # the prefix, and its tail with the next word
        if not len(start):
            return None
        code = ids[start]
        for k in range(1, size):  # below 2^63: a chunk has fewer than 2^21 words
            code = code * v + ids[start + k]
        code, first, prefix = np.unique(code, return_index=True, return_inverse=True)
        first = start[first]
        key, count = np.unique(prefix * v + ids[start + size], return_counts=True)
        prefix, nxt = key // v, key % v
        parts = np.array([heavy.get(x, 1) for x in h[first].tolist()] if heavy else [1] * len(first), np.uint64)
        part = (hashed[nxt] % parts[prefix]).astype(np.int64)
        names = pc.binary_join_element_wise(*(texts.take(pa.array(ids[first + k])) for k in range(size)), " ")
    order = np.lexsort((part, prefix))
    prefix, part, nxt, count = prefix[order], part[order], nxt[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]))
    return _batch(pa.array([lang] * len(new), pa.string()), names.take(pa.array(prefix[new])), part[new],
                  np.append(new, len(order)), texts.take(pa.array(nxt)), count)


def _batch(lang, prefix, part, offsets, nxt, count) -> pa.RecordBatch:
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nxt), " ")
    packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer((np.asarray(offsets) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(count, np.int64))])
    return pa.RecordBatch.from_arrays([lang, prefix, pa.array(part, pa.int32()), joined, packed], schema=_SCHEMA)


def _entries(rows: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(entries of each stripe, all next words, all counts)."""
    words = pc.split_pattern(rows.column("next"), " ")
    packed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("count")), b"")
    return pc.list_value_length(words), words.flatten(), np.frombuffer(packed[0].as_buffer(), np.int64)


def _counted(size: int, shared):
    """Partition function: (lang, text as bytes) -> stripes of prefixes of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, heavy = shared.value if shared else (None, {})
        held: dict[str, list[pa.Array]] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for found, last in _slices(text.as_py()):
                    if last:
                        found.append(_BREAK)
                    held.setdefault(lang, []).append(pa.array(found, pa.binary()))
                    total += len(found)
                    if total < CHUNK:
                        continue
                    for key in list(held):
                        tokens, goes_on = pa.concat_arrays(held.pop(key)), key == lang and not last
                        out = _stripes_of(tokens, key, size, bitmap, heavy)
                        if out is not None:
                            yield out
                        if goes_on and size:
                            held[key] = [tokens[max(0, len(tokens) - size):]]
                    total = sum(len(x) for parts in held.values() for x in parts)
        for key, parts in held.items():
            out = _stripes_of(pa.concat_arrays(parts), key, size, bitmap, heavy)
            if out is not None:
                yield out

    return run


def _merge_sorted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Stripes of equal (lang, prefix, part), which follow each other, added elementwise."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in ("lang", "prefix", "part"):
        c = rows.column(name)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(new) - 1
    size, words, count = _entries(rows)
    coded = words.dictionary_encode()
    v = len(coded.dictionary)
    key = np.repeat(group, size.to_numpy()) * v + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.add.reduceat(count[order], start)
    key = key[start]
    first = pa.array(np.flatnonzero(new))
    offsets = np.searchsorted(key // v, np.arange(len(first) + 1))
    return _batch(rows.column("lang").take(first), rows.column("prefix").take(first), rows.column("part").take(first),
                  offsets, coded.dictionary.take(pa.array(key % v)), count)


def _merged(least: int):
    """Partition function: stripes sorted by key -> merged ones: their sum, and the entries of at least ``least``."""

    def final(rows: pa.RecordBatch) -> pa.RecordBatch:
        size, nxt, count = _entries(rows)
        offsets = np.concatenate([[0], np.cumsum(size.to_numpy())])
        keep = count >= least
        kept = pa.array(np.concatenate([[0], np.cumsum(keep)])[offsets], pa.int32())
        pick = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays(
            [rows.column("lang"), rows.column("prefix"), pa.array(np.add.reduceat(count, offsets[:-1])),
             pa.ListArray.from_arrays(kept, nxt.take(pick)), pa.ListArray.from_arrays(kept, pa.array(count[keep]))],
            names=["lang", "prefix", "total", "next", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last stripe may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(_SCHEMA)
            rows = _merge_sorted(batch if rest is None else pa.concat_batches([rest, batch]))
            if rows.num_rows > 1:
                yield final(rows[:-1])
            rest = rows[-1:]
        if rest is not None:
            yield final(rest)

    return run


def phrase_hash(lang: Column, words: Column) -> Column:
    """The hash of a phrase that ``_stripes_of`` computes from its words."""
    turn = lambda h, w: F.shiftleft(h, 7).bitwiseOR(F.shiftrightunsigned(h, 57)).bitwiseXOR(F.xxhash64(w))
    return F.aggregate(words, F.xxhash64(lang), turn)


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Two bits for each hash ``h``; ``BITS`` bits in all, whatever the number of phrases."""
    bit = lambda h: h.bitwiseAND(F.lit(BITS - 1).cast("long")) + 1  # noqa: E731 (buckets start at 1)
    bits = phrases.select(F.explode(F.array(bit(F.col("h")), bit(F.shiftrightunsigned("h", 32)))).alias("bit"))
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # at most 4,096
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * (_BUCKET // 8)
        out[at:at + len(part)] = part
    return out


def stripes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
            words: int = WORDS) -> list[DataFrame]:
    """For each prefix length from 0 the merged stripes (lang, prefix, total, next, count):
    ``next`` and ``count`` hold the entries of at least ``least``, ``total`` sums all
    that were counted (for the empty prefix: all words).

    A split stripe has several rows. The list ends before the first length
    whose prefixes cannot be frequent.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    out: list[DataFrame] = []
    shared, n = None, 0
    for size in range(words):
        raw = texts.mapInArrow(_counted(size, shared), _STRIPE)
        key = ["lang", "prefix", "part"]
        merged = raw.repartition(*key).sortWithinPartitions(*key).mapInArrow(
            _merged(least), "lang string, prefix string, total long, next array<string>, count array<long>")
        out.append(stored(merged, f"stripes-{size}"))
        if size + 1 == words:
            break
        found = entries(out[-1]).select(phrase_hash(F.col("lang"), F.split("phrase", " ")).alias("h"), "a")
        found = stored(found, "frequent")
        n = n or out[0].agg(F.sum("total")).first()[0] or 0
        heavy = found.filter((F.col("a") >= n / HEAVY) & (F.col("a") > SHARE)).collect()  # at most HEAVY
        if found.isEmpty():
            break
        shared = spark.sparkContext.broadcast((_bitmap(found), {r["h"] % 2 ** 64: -(-r["a"] // SHARE) for r in heavy}))
    return out


def entries(level: DataFrame) -> DataFrame:
    """(lang, phrase, a, prefix): the frequent entries of merged stripes as phrases."""
    each = level.select("lang", "prefix", F.explode(F.arrays_zip("next", "count")).alias("e"))
    return each.select("lang", F.when(F.col("prefix") == "", F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next")).alias("phrase"),
                       F.col("e.count").alias("a"), "prefix")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 words: int = WORDS, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    A-Z are lower-cased, texts cut at ``. , ; : ! ?`` and \\x0A-\\x0D, pieces at
    spaces and tabs. Phrases of 2 to ``words`` words that occur at least ``least``
    times in a language are scored floor(2000000 a / (l + r)) by their lowest
    cut into a first part (l occurrences) and a rest (r), the shortest first
    part of equal ones. A phrase is left out if a phrase of at least
    ``least`` occurrences that holds it has ``covered`` percent of its
    occurrences. The first ``top`` of a language stay, by score, then a, both descending,
    then phrase in byte order; n counts all words of the language.

    A null language is ``und``; null and empty texts have no words. Texts are
    taken whole, long ones slice by slice. Repeated rows count each; other
    columns are not looked at; without candidates there are no rows.
    """
    levels = stripes(docs, lang_col, text_col, least, words)
    n = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    phrases = None
    longer = None
    for level in levels[1:]:
        found = entries(level)
        # one word more on either side: a longer phrase that covers one covers those between, too
        over = (level.select("lang", F.col("prefix").alias("phrase"), F.array_max("count").alias("over")).filter("over is not null")
                .union(found.select("lang", F.expr("substr(phrase, locate(' ', phrase) + 1)").alias("phrase"), F.col("a").alias("over"))))
        phrases = found if phrases is None else phrases.union(found)
        longer = over if longer is None else longer.union(over)
    if phrases is None:
        return docs.sparkSession.createDataFrame(
            [], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    left = (phrases.select("lang", "phrase", "a", F.lit(None).cast("long").alias("over"))
            .union(longer.select("lang", "phrase", F.lit(None).cast("long"), "over"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("over").alias("over"))
            .filter(F.col("a").isNotNull() & F.expr(
                f"coalesce(cast(over as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(covered)}, true)")))
    parts = F.split("phrase", " ")
    cuts = (left.select("lang", "phrase", "a", parts.alias("w")).withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
            .select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
                    F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("rest")))
    # a prefix's total is its entry one level before
    totals = stored(entries(levels[0]).unionByName(phrases).select("lang", "phrase", "a"), "totals")
    cuts = (cuts.join(totals.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
            .join(totals.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    scored = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
