"""Hierarchical Pitman-Yor language model, its seating sampled by distributed Gibbs rounds.

Restaurants: one for each previous word; those whose word has the same class
(``CONTEXTS`` classes) share a parent, and all classes share the unigram
restaurant, whose base is uniform over the vocabulary and one unseen word.

A word with all pairs (previous word, word) that end in it lies in one of a number of
buckets that grows with the texts; a bucket is a row of packed arrays (a stripe), so that
its seats are kept and seated by numpy in one group. A pair seen once has one table for
good; only the others are seated again. A round seats the pairs, given the seats of the
words and the tables of each previous word of the round before, then the words, given
the tables of the pairs. Only the tables by previous word leave a bucket: they are dealt
to buckets of previous words, summed there, and told to the buckets that asked. The last
rounds are kept as samples; a pair's probability is the average of the samples' predictive
ones. A bucket is as large as what its words were met after; a word's pairs are not split.

Pairs that make up ``FREQUENT`` of all tokens or more are at most 1 / FREQUENT many; they
are broadcast and scored where the text lies. The other tokens are dealt to their words'
buckets, a slice of the documents at a time, and come back as sums by document.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

CONTEXTS = 16  # classes of the previous word; 0: the start of a text
DISCOUNT_2, STRENGTH_2 = 0.8, 1.0  # of a previous word's restaurant
DISCOUNT, STRENGTH = 0.6, 1.0  # of a class restaurant
DISCOUNT_0, STRENGTH_0 = 0.4, 10.0  # of the unigram restaurant
BURN_IN = 3  # rounds before the first sample
SAMPLES = 3
FREQUENT = 2e-6
BASE_ADD = 0.1
BUCKET_BYTES = 16 << 20  # of training text to a bucket
LEAST_BUCKETS = 64
BLOCK_TOKENS = 2_000_000  # tokens that a task gathers before it deals them out
SLICES = 2  # of the documents, from SLICE_TOKENS training tokens on
SLICE_TOKENS = 4_000_000
_END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word holds a space
_ALL = (1 << 64) - 1
_BLOCK = 0.1  # beyond ten customers, so many more are seated at one time


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, previous words) of a whole text, A-Z lower-cased, with one end.
    A previous word is its hash with its class in the last four bits; 0: the start."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    w = raw.split()
    h = np.empty(len(w) + 1, np.uint64)
    h[:-1] = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), ">u8")
    h[-1] = _END
    ctx = np.zeros(len(w) + 1, np.int64)
    if w:
        code = np.frombuffer(raw, np.uint8)
        space = (code == 32) | ((code - np.uint8(9)) < 5)
        last = np.flatnonzero(np.append(space[1:], True) & ~space)
        before = np.where((last > 0) & ~space[last - 1], code[last - 1], 0).astype(np.int64)
        ctx[1:] = 1 + ((code[last].astype(np.int64) * 131 + before * 7) * 2654435761 >> 12) % (CONTEXTS - 1)
    u = np.zeros(len(w) + 1, np.uint64)
    u[1:] = h[:-1] & np.uint64(_ALL - CONTEXTS + 1) | ctx[1:].astype(np.uint64)
    return h, u


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of previous words and words."""
    return (u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _normal(u: np.ndarray) -> np.ndarray:
    """Quantiles of the normal distribution (rational approximation, error below 5e-4)."""
    t = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
    return np.where(u < 0.5, -x, x)


def _binomial(m: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial draws from uniform numbers: inverted exactly up to a mean of 30,
    beyond it by the normal distribution."""
    flip = p > 0.5
    q = np.where(flip, 1 - p, p)
    out = np.zeros(len(m), np.int64)
    many = m * q > 30
    mean, sd = m[many] * q[many], np.sqrt(m[many] * q[many] * (1 - q[many]))
    out[many] = np.clip(np.rint(mean + sd * _normal(u[many])), 0, m[many])
    live = np.flatnonzero(~many)
    term = np.exp(m[live] * np.log1p(-q[live]))
    left = u[live] - term
    k = 0
    while True:
        on = (left > 0) & (m[live] > k)
        live, term, left = live[on], term[on], left[on]
        if not len(live):
            break
        term = term * (m[live] - k) / (k + 1) * q[live] / (1 - q[live])
        left = left - term
        k += 1
        out[live] = k
    return np.where(flip, m - out, out)


def _seat(customers: np.ndarray, new: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables after the customers of a dish are seated one after the other, for
    many dishes at once; ``new`` is a dish's weight of opening a table.

    The n-th customer opens a table with odds new : n - discount * tables. The
    first ten come singly, later ones in blocks of a tenth of those seated. The
    draws follow from the dishes' seeds alone.
    """
    tables = (customers > 0).astype(np.int64)
    seated = tables.copy()
    live = np.flatnonzero(customers > 1)
    step = 0
    while len(live):
        n, t, a = seated[live], tables[live], new[live]
        more = np.minimum(np.maximum(1, (n * _BLOCK).astype(np.int64)), customers[live] - n)
        step += 1
        u = (_mix(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 & _ALL)) >> np.uint64(11)) * 2.0 ** -53
        u = np.clip(u, 1e-15, 1 - 1e-15)
        p = a / (a + n - discount * t)
        tables[live] = t + np.where(more == 1, u < p, _binomial(more, p, u))
        seated[live] = n + more
        live = live[seated[live] < customers[live]]
    return tables


@dataclass
class Totals:
    """What a round knows of all words: customers and tables of each restaurant."""

    customers: np.ndarray  # of the contexts
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    vocabulary: int

    def parent(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Unigram predictive probability of dishes with c customers and t tables."""
        fresh = (STRENGTH_0 + DISCOUNT_0 * self.parent_tables) / (self.vocabulary + 1)
        return (c - DISCOUNT_0 * t + fresh) / (STRENGTH_0 + self.parent_customers)

    def back_off(self) -> np.ndarray:
        """Share of a context's probability that its parent gives out."""
        return (STRENGTH + DISCOUNT * self.tables) / (STRENGTH + self.customers)

    def context(self, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (c - DISCOUNT * t) / (STRENGTH + self.customers[ctx]) + self.back_off()[ctx] * p


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


# A stripe: its bucket, what its parts are, the bucket it came from, packed arrays, numbers to be summed.
_STRIPES = "bucket int, kind int, other int, parts array<binary>, sums array<double>"
_FIELDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("other", pa.int32()), ("parts", pa.list_(pa.binary())),
                     ("sums", pa.list_(pa.float64()))])
_PAIRS, _SEATS, _ASKED, _TOLD, _BACK, _TOKENS, _SUMS, _REST = range(8)


def _pack(x: np.ndarray) -> bytes:
    """An array with its type, so that small numbers and sorted hashes take fewer bytes."""
    if x.dtype == np.uint64 and len(x) > 1 and (x[1:] >= x[:-1]).all():
        # steps between sorted hashes, their highest bytes, mostly zero, together
        return b"up:" + np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    if x.dtype != np.int64 or not len(x) or x.min() < 0:
        return x.dtype.str.encode() + x.tobytes()
    large = x[x >= 255]
    if 8 * len(large) < len(x):
        return b"few" + len(large).to_bytes(8, "little") + large.tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()
    if x.max() < 1 << 32:
        x = x.astype(np.min_scalar_type(int(x.max())))
    return x.dtype.str.encode() + x.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:3] == b"up:":
        return np.cumsum(np.frombuffer(raw, np.uint8, offset=3).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)
    if raw[:3] == b"few":
        large = np.frombuffer(raw, np.int64, int.from_bytes(raw[3:11], "little"), 11)
        x = np.frombuffer(raw, np.uint8, offset=11 + large.nbytes).astype(np.int64)
        if len(large):
            x[x == 255] = large
        return x
    x = np.frombuffer(raw, raw[:3].decode(), offset=3)
    return x.astype(x.dtype if raw[:3] in (b"<u8", b"<f8") else np.int64)


def _stripes(rows: list[tuple[int, int, int, list[np.ndarray], list[float] | None]]) -> pa.RecordBatch:
    bucket, kind, other, parts, sums = zip(*rows) if rows else [()] * 5
    columns = (bucket, kind, other, [[_pack(x) for x in p] for p in parts], sums)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """(bucket, kind, other, arrays) of each stripe."""
    bucket, kind, other = (batch.column(c).to_pylist() for c in ("bucket", "kind", "other"))
    for i in range(len(bucket)):
        yield bucket[i], kind[i], other[i], [_unpack(x) for x in batch.column("parts")[i].as_py()]


def _each(stripes: DataFrame, make: Callable, schema: str = _STRIPES) -> DataFrame:
    """What ``make`` gives for each stripe (bucket, kind, other, arrays): a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield make(*row)

    return stripes.mapInArrow(run, schema)


def _by_bucket(stripes: DataFrame, make: Callable, schema: str = _STRIPES) -> DataFrame:
    """What ``make`` gives for all stripes of each bucket: a batch."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([make(list(_rows(table)))])

    return stripes.groupBy("bucket").applyInArrow(run, schema)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes; they rise with the hash."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(x: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets that the sorted hashes ``x`` fall in."""
    edge = np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1)).tolist()
    return ((i, a, b) for i, (a, b) in enumerate(zip(edge, edge[1:])) if a < b)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _total(index: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.rint(np.bincount(index, x, n)).astype(np.int64)


def _counted(w: np.ndarray, u: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs by word, with the sums of ``n`` (none: how many there are)."""
    key = _pair(u, w)
    order = np.argsort(key)
    key, w, u = key[order], w[order], u[order]
    new = _starts(w, u)
    if len(new) > len(_starts(key)):  # two pairs with one hash
        order = order[np.lexsort((u, w))]
        w, u = np.sort(w), u[np.lexsort((u, w))]
        new = _starts(w, u)
    n = _sizes(new, len(w)) if n is None else np.add.reduceat(n[order], new)
    w, u = w[new], u[new]
    order = np.argsort(w)
    return w[order], u[order], n[order]


def _blocks(texts: Iterator[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, previous words, places of their texts, the texts' keys) of many texts (key, text) at a time."""
    held, size = [], 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, w, u = zip(*held)
        return np.concatenate(w), np.concatenate(u), np.repeat(np.arange(len(key)), list(map(len, w))), np.array(key, np.int64)

    for key, text in texts:
        held.append((key, *tokens(text)))
        size += len(held[-1][1])
        if size >= BLOCK_TOKENS:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def _pair_table(train: DataFrame, buckets: int) -> DataFrame:
    """The pairs of each bucket, how often a word follows a previous word, from all
    texts: words, previous words, how many pairs each of them begins, the places of the
    pairs' words, counts."""

    def parts(w: np.ndarray, u: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        new = _starts(w)
        return [w[new], _sizes(new, len(w)), u, n]

    def by_previous(w: np.ndarray, u: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        new = _starts(w)
        word = np.repeat(np.arange(len(new)), _sizes(new, len(w)))
        order = np.argsort(u)
        u = u[order]
        first = _starts(u)
        return [w[new], u[first], _sizes(first, len(u)), word[order], n[order]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, u, _, _ in _blocks((0, t) for batch in batches for t in batch.column("text").to_pylist()):
            w, u, n = _counted(w, u)
            yield _stripes([(i, _PAIRS, 0, parts(w[a:b], u[a:b], n[a:b]), None) for i, a, b in _cuts(w, buckets)])

    def merge(rows: list) -> pa.RecordBatch:
        w, u, n = (np.concatenate(x) for x in zip(*((np.repeat(p[0], p[1]), p[2], p[3]) for *_, p in rows)))
        return _stripes([(rows[0][0], _PAIRS, 0, by_previous(*_counted(w, u, n)), None)])

    return stored(_by_bucket(train.select("text").mapInArrow(run, _STRIPES), merge), "pairs")


def _more(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the pairs seen more than once, by word: the order of their seats."""
    more = np.flatnonzero(n > 1)
    return more[np.argsort(word[more], kind="stable")]


class _Seats:
    """The seats of a bucket: of its words, of the classes that have seen each word, and
    of its pairs seen more than once. Words are in order, and the classes of each."""

    FIXED = ("w", "count", "classes", "ctx", "fixed", "pairs", "previous", "place", "n", "one")

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        for name, x in zip(self.FIXED, parts):
            setattr(self, name, x)
        kept = parts[len(self.FIXED):]
        #: of each kept round: tables of the pairs, customers and tables by class, the parent's tables by word
        self.kept = [kept[i:i + 4] for i in range(0, len(kept), 4)]

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.w)), self.classes)

    @cached_property
    def key(self) -> np.ndarray:
        return self.row * CONTEXTS + self.ctx

    @cached_property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.w)), self.pairs)

    @cached_property
    def u(self) -> np.ndarray:
        return self.previous[self.place]

    @cached_property
    def pair_ctx(self) -> np.ndarray:
        return (self.u & np.uint64(CONTEXTS - 1)).astype(np.int64)

    @cached_property
    def seat(self) -> np.ndarray:
        return np.searchsorted(self.key, self.word * CONTEXTS + self.pair_ctx)

    @classmethod
    def first(cls, w: np.ndarray, u: np.ndarray, size: np.ndarray, word: np.ndarray, n: np.ndarray, told: np.ndarray) -> _Seats:
        """Every dish has one table; ``told``: how many pairs are seen once of each previous word that has others."""
        place = np.repeat(np.arange(len(u)), size)
        ctx = (u & np.uint64(CONTEXTS - 1)).astype(np.int64)
        key, at = np.unique(word * CONTEXTS + ctx[place], return_inverse=True)
        more = _more(word, n)
        ones = np.ones(len(key), np.int64)
        others = np.bincount(place[more], minlength=len(u)) > 0
        rank = np.cumsum(others) - 1
        return cls([w, _total(word, n, len(w)), np.bincount(key // CONTEXTS, minlength=len(w)), key % CONTEXTS, _total(at, n == 1, len(key)),
                    np.bincount(word[more], minlength=len(w)), u[others], rank[place[more]], n[more], told,
                    np.ones(len(more), np.int64), np.bincount(at, minlength=len(key)), ones, np.ones(len(w), np.int64)])

    def sum(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, len(self.w))

    def tables(self, k: int) -> np.ndarray:
        """Tables of the pairs by previous word in the k-th kept round."""
        return _total(self.place, self.kept[k][0], len(self.previous))

    def pairs_round(self, totals: Totals, number: int, k: int, tables: np.ndarray) -> np.ndarray:
        """Tables of the pairs after their customers sat down anew; ``tables``: of each previous word."""
        t, c, by_class, parent = self.kept[k]
        # the parents without the dish's customers of this restaurant
        own = c[self.seat] - t
        q = by_class[self.seat]
        share = np.where(own > 0, np.minimum(q, own), 0)
        own0 = self.sum(by_class).astype(np.int64)[self.word] - (q - share)
        p = totals.context(self.pair_ctx, own, share, totals.parent(own0, np.where(own0 > 0, np.minimum(parent[self.word], own0), 0)))
        seed = _mix(_mix(self.w + np.uint64((number + 1) * 0xA0761D6478BD642F & _ALL))[self.word] + self.u)
        all_tables = (tables + self.one)[self.place]
        return _seat(self.n, (STRENGTH_2 + DISCOUNT_2 * (all_tables - t).clip(0)) * p, DISCOUNT_2, seed)

    def words_round(self, totals: Totals, number: int, k: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables by class, parent's tables by word) after all customers ``c`` sat down
        anew; the draws follow from the words and the round's number alone."""
        _, _, t, t0 = self.kept[k]
        seed = _mix(self.w + np.uint64((number + 1) * 0xD6E8FEB86659FD93 & _ALL))
        c0 = self.sum(t)
        # the parent without the dish's customers of this restaurant
        own = c0[self.row] - t
        share = np.where(own > 0, np.minimum(t0[self.row], own), 0)
        p = totals.parent(own, share)
        t = _seat(c, (STRENGTH + DISCOUNT * (totals.tables[self.ctx] - t).clip(0)) * p, DISCOUNT, _mix(seed[self.row] + self.ctx.astype(np.uint64)))
        c0 = self.sum(t).astype(np.int64)
        fresh = (STRENGTH_0 + DISCOUNT_0 * max(0.0, totals.parent_tables)) / (totals.vocabulary + 1)
        return t, _seat(c0, np.full(len(self.w), fresh), DISCOUNT_0, seed)

    def round(self, totals: Totals, number: int, k: int, out: int, tables: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
        """The parts after one more round, whose seats are the ``out``-th of those kept, and its sums."""
        pairs = self.pairs_round(totals, number, k, tables)
        c = self.fixed + _total(self.seat, pairs, len(self.fixed))
        t, t0 = self.words_round(totals, number, k, c)
        size = len(self.FIXED) + 4 * out
        return [*self.parts[:size], pairs, c, t, t0], self.sums(t, c, t0)

    def sums(self, t: np.ndarray, c: np.ndarray, t0: np.ndarray) -> list[float]:
        return [*np.bincount(self.ctx, t, CONTEXTS), *np.bincount(self.ctx, c, CONTEXTS), float(t0.sum()), float(len(self.w)),
                float(self.count.sum())]

    def predictive(self, samples: list[Totals]) -> tuple[np.ndarray, np.ndarray]:
        """Parent probabilities by sample and word, predictive ones by sample and class of each word."""
        p0, each = [], []
        for totals, (_, c, t, t0) in zip(samples, self.kept):
            p0.append(totals.parent(self.sum(t), t0))
            each.append(totals.context(self.ctx, c, t, p0[-1][self.row]))
        return np.array(p0), np.array(each)


def _asked(bucket: int, u: np.ndarray, wants: np.ndarray, values: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """What a bucket knows of previous words in order, dealt to their buckets; it wants to be told the sums of those marked."""
    return _stripes([(i, _ASKED, bucket, [x[a:b] for x in (u, wants, *values)], None) for i, a, b in _cuts(u, buckets)])


def _told(asked: DataFrame, back: bool = False) -> DataFrame:
    """The sums over all buckets, in the order in which they were asked for, and with
    ``back`` those of every previous word."""

    def tell(rows: list) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*(p for *_, p in rows))]
        u, at = np.unique(columns[0].view(np.uint64), return_inverse=True)
        sums = [_total(at, x, len(u)) for x in columns[2:]]
        edge, out = np.cumsum([0] + [len(p[0]) for *_, p in rows]), []
        for (bucket, _, other, p), a in zip(rows, edge):
            place = at[a:a + len(p[0])][p[1] > 0]
            if len(place):
                out.append((other, _TOLD, bucket, [x[place] for x in sums], None))
        return _stripes(out + [(rows[0][0], _BACK, 0, [u, *sums], None)] * back)

    return _by_bucket(asked, tell)


def _heard(rows: list) -> list[np.ndarray]:
    """The sums told to a bucket, in the order of the previous words it asked for."""
    found = sorted((other, i) for i, (_, kind, other, _) in enumerate(rows) if kind == _TOLD)
    return [np.concatenate(x) for x in zip(*(rows[i][3] for _, i in found))] or [np.zeros(0, np.int64)]


def _part(rows: list, kind: int) -> list[np.ndarray]:
    return next(p for _, k, _, p in rows if k == kind)


def _tidy(spark: SparkSession, *frames: DataFrame) -> None:
    """Discard ``frames``, and let Spark delete the shuffle files that nothing refers to,
    which it does when the driver's JVM collects its garbage."""
    discard(*frames)
    gc.collect()
    spark._jvm.System.gc()


def _begun(pairs: DataFrame, buckets: int) -> DataFrame:
    """The seats of each bucket at first."""

    def ask(bucket: int, kind: int, other: int, p: list[np.ndarray]) -> pa.RecordBatch:
        _, u, size, _, n = p
        at = np.repeat(np.arange(len(u)), size)
        return _asked(bucket, u, np.minimum(_total(at, n > 1, len(u)), 1), [_total(at, n == 1, len(u))], buckets)

    def begin(rows: list) -> pa.RecordBatch:
        seats = _Seats.first(*_part(rows, _PAIRS), _heard(rows)[0])
        return _stripes([(rows[0][0], _SEATS, 0, seats.parts, seats.sums(*(seats.kept[0][i] for i in (2, 1, 3))))])

    return _by_bucket(pairs.unionByName(_told(_each(pairs, ask))), begin)


def _seated(seats: DataFrame, totals: Totals, number: int, kept: int, out: int, buckets: int) -> DataFrame:
    """The seats of each bucket after one more round, the ``out``-th of those kept."""

    def ask(bucket: int, kind: int, other: int, p: list[np.ndarray]) -> pa.RecordBatch:
        s = _Seats(p)
        return _asked(bucket, s.previous, np.ones(len(s.previous), np.int64), [s.tables(kept - 1)], buckets)

    def seat(rows: list) -> pa.RecordBatch:
        parts, sums = _Seats(_part(rows, _SEATS)).round(totals, number, kept - 1, out, _heard(rows)[0])
        return _stripes([(rows[0][0], _SEATS, 0, parts, sums)])

    return _by_bucket(seats.unionByName(_told(_each(seats, ask))), seat)


def _sums(seats: DataFrame) -> np.ndarray:
    row = seats.select(*(F.sum(F.get("sums", F.lit(i))) for i in range(2 * CONTEXTS + 3))).first()
    return np.array([x or 0.0 for x in row])


_CLASS = f"cast(u & {CONTEXTS - 1} as int)"


@dataclass
class Model:
    pairs: DataFrame  # stripes of all pairs and their counts
    seats: DataFrame  # stripes of the seats of each sample
    backs: DataFrame  # stripes of the sums by previous word, and what was told of them to each bucket
    samples: list[Totals]
    tokens: int
    vocabulary: int
    buckets: int

    @property
    def base_den(self) -> float:
        return self.tokens + BASE_ADD * (self.vocabulary + 1)

    def probabilities(self) -> DataFrame:
        """(w, c, p, ctx, seen, each): parent probabilities by sample, and the classes
        that have seen the word with its predictive probability in each, averaged and
        by sample."""
        samples = self.samples
        one = len(samples)

        def make(bucket: int, kind: int, other: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            s = _Seats(parts)
            p0, each = s.predictive(samples)
            offsets = np.concatenate([[0], np.cumsum(s.classes)])
            return pa.RecordBatch.from_pydict({
                "w": s.w.view(np.int64), "c": s.count,
                "p": _lists(np.arange(len(s.w) + 1) * one, p0.T.ravel()),
                "ctx": _lists(offsets, s.ctx.astype(np.int32)), "seen": _lists(offsets, each.mean(0)),
                "each": _lists(offsets, _lists(np.arange(len(s.ctx) + 1) * one, each.T.ravel()))})

        return _each(self.seats, make, "w long, c long, p array<double>, ctx array<int>, seen array<double>, each array<array<double>>")

    def backing(self) -> DataFrame:
        """(u, den, back): of each previous word the denominator of its predictive
        probabilities, and by sample the share that its class gives out."""
        one = len(self.samples)

        def make(bucket: int, kind: int, other: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            den, back = _backing(parts[1:])
            return pa.RecordBatch.from_pydict({"u": parts[0].view(np.int64), "den": den,
                                               "back": _lists(np.arange(len(den) + 1) * one, back.T.ravel())})

        return _each(self.backs.filter(F.col("kind") == _BACK), make, "u long, den double, back array<double>")

    def counted(self, least: float) -> DataFrame:
        """(u, w, n, t0, t1, ...): the pairs seen ``least`` times or more, with their tables in each sample."""
        ks = range(len(self.samples))

        def more(bucket: int, kind: int, other: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            s = _Seats(parts)
            on = s.n >= least
            return pa.RecordBatch.from_pydict({"u": s.u.view(np.int64)[on], "w": s.w.view(np.int64)[s.word[on]], "n": s.n[on],
                                               **{f"t{k}": s.kept[k][0][on] for k in ks}})

        def once(bucket: int, kind: int, other: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            w, u, size, word, n = parts
            on = n == 1
            return pa.RecordBatch.from_pydict({"u": np.repeat(u.view(np.int64), size)[on], "w": w.view(np.int64)[word[on]], "n": n[on],
                                               **{f"t{k}": n[on] for k in ks}})

        schema = "u long, w long, n long" + "".join(f", t{k} long" for k in ks)
        found = _each(self.seats, more, schema)
        return found if least > 1 else found.unionByName(_each(self.pairs, once, schema))

    def seen(self, words: DataFrame, backing: DataFrame, least: float = 1) -> DataFrame:
        """(u, w, n, c, s): the pairs seen ``least`` times or more in the training texts,
        how often the word came, and the log10 of the pair's averaged predictive
        probability; from ``probabilities`` and ``backing``."""
        ks = range(len(self.samples))
        pairs = self.counted(least)
        dishes = words.select("w", "c", F.explode(F.arrays_zip("ctx", "each")).alias("x")).select(
            "w", "c", F.col("x")["ctx"].alias("ctx"), F.col("x")["each"].alias("each"))
        p = sum(((F.col("n") - DISCOUNT_2 * F.col(f"t{k}")) / F.col("den") + F.get("back", F.lit(k)) * F.get("each", F.lit(k))
                 for k in ks), F.lit(0.0)) / len(self.samples)
        pairs = pairs.withColumn("ctx", F.expr(_CLASS))
        if least > 1:
            pairs = F.broadcast(pairs)
        return pairs.join(dishes, ["w", "ctx"]).join(backing, "u").select(
            "u", "w", "n", "c", F.log10(p).cast("float").alias("s"))


def _backing(sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Denominators of previous words and, by sample, the shares that their classes give out."""
    m, one, *tables = sums
    den = m + STRENGTH_2
    return den, (STRENGTH_2 + DISCOUNT_2 * (one + np.array(tables))) / den


def fit(train: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Model of the texts of ``train`` (column ``text``). The draws depend on the
    pairs and words alone, so a rerun or a retried task seats alike."""
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    pairs = _pair_table(train, buckets)
    _tidy(spark)
    seats = stored(_begun(pairs, buckets), "seats")
    _tidy(spark)
    sums = _sums(seats)
    tables, customers, (_, vocabulary, n) = sums[:CONTEXTS], sums[CONTEXTS:2 * CONTEXTS], sums[2 * CONTEXTS:]
    # at first every dish has one table in a restaurant
    now = Totals(customers, tables, float(tables.sum()), float(vocabulary), int(vocabulary))
    kept: list[Totals] = []
    for number in range(burn_in + samples):
        last = max(1, len(kept))  # sets of seats so far; the new one replaces the last before the first sample
        after = stored(_seated(seats, now, number, last, len(kept), buckets), "seats")
        _tidy(spark, seats)
        seats = after
        sums = _sums(seats)
        tables = sums[:CONTEXTS]
        now = Totals(sums[CONTEXTS:2 * CONTEXTS], tables, float(tables.sum()), float(sums[2 * CONTEXTS]), int(vocabulary))
        if number >= burn_in:
            kept.append(now)
    backs = stored(_told(_by_previous(pairs, seats, samples, buckets), back=True), "backs")
    _tidy(spark)
    return Model(pairs, seats, backs, kept, int(n), int(vocabulary), buckets)


def _by_previous(pairs: DataFrame, seats: DataFrame, samples: int, buckets: int) -> DataFrame:
    """What each bucket knows of all its previous words: how often they were met, their
    pairs seen once, and the tables of the others in each sample."""

    def met(bucket: int, kind: int, other: int, p: list[np.ndarray]) -> pa.RecordBatch:
        _, u, size, _, n = p
        at = np.repeat(np.arange(len(u)), size)
        none = np.zeros(len(u), np.int64)
        return _asked(bucket, u, none + 1, [_total(at, n, len(u)), _total(at, n == 1, len(u)), *[none] * samples], buckets)

    def seated(bucket: int, kind: int, other: int, p: list[np.ndarray]) -> pa.RecordBatch:
        s = _Seats(p)
        none = np.zeros(len(s.previous), np.int64)
        return _asked(bucket, s.previous, none, [none, none, *map(s.tables, range(samples))], buckets)

    return _each(pairs, met).unionByName(_each(seats, seated))


def _find(key: np.ndarray, asked: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Places in the sorted hashes ``key`` of those asked for that are ``same`` (places, numbers asked); -1: none."""
    found = np.full(len(asked), -1)
    live = np.argsort(asked)
    at = np.searchsorted(key, asked[live])
    while len(live):
        on = at < len(key)
        on[on] = key[at[on]] == asked[live[on]]
        live, at = live[on], at[on]
        hit = same(at, live)
        found[live[hit]] = at[hit]
        live, at = live[~hit], at[~hit] + 1  # another pair with this hash
    return found


def _sums_of(keys: np.ndarray, at: np.ndarray, buckets: int, *columns: np.ndarray) -> list:
    """Stripes of sums by document, dealt by their sorted ``keys``: tokens, known ones, base scores, scores."""
    sums = [np.bincount(at, x, len(keys)) for x in columns]
    sums[:2] = (np.rint(x).astype(np.int64) for x in sums[:2])
    return [(i, _SUMS, 0, [x[a:b] for x in (keys, *sums)], None) for i, a, b in _cuts(keys, buckets)]


def _met(rows: list, samples: list[Totals], base_den: float, buckets: int) -> pa.RecordBatch:
    """Log10 probabilities of the tokens that were dealt to a bucket, summed by document;
    and the tokens whose previous word this bucket has not met, dealt by previous word,
    with what their class makes of the word in each sample."""
    passed = [(*r, None) for r in rows if r[1] == _SUMS]
    dealt = [p for _, kind, _, p in rows if kind == _TOKENS]
    if not dealt:
        return _stripes(passed)
    keys, place = np.unique(np.concatenate([p[4] for p in dealt]), return_inverse=True)
    edge = np.cumsum([0] + [len(p[4]) for p in dealt])
    w, u, doc = (np.concatenate(x) for x in zip(*((np.repeat(p[0], p[1]), p[2], place[p[3] + a]) for p, a in zip(dealt, edge))))
    ctx = (u & np.uint64(CONTEXTS - 1)).astype(np.int64)
    back_off = np.array([t.back_off() for t in samples])
    unseen = np.array([t.parent(np.zeros(1), np.zeros(1))[0] for t in samples])
    each = back_off[:, ctx] * unseen[:, None]
    c, p = np.zeros(len(w), np.int64), np.zeros(len(w))
    seen, told = np.zeros(len(w), bool), np.zeros(len(w), bool)
    if any(kind == _PAIRS for _, kind, _, _ in rows):
        s = _Seats(_part(rows, _SEATS))
        word = np.minimum(np.searchsorted(s.w, w), len(s.w) - 1)
        known = s.w[word] == w
        p0, by_class = s.predictive(samples)
        each = np.where(known, back_off[:, ctx] * p0[:, word], each)
        at = np.minimum(np.searchsorted(s.key, word * CONTEXTS + ctx), len(s.key) - 1)
        each = np.where(known & (s.key[at] == word * CONTEXTS + ctx), by_class[:, at], each)
        c = np.where(known, s.count[word], 0)
        pw, previous, size, of, n = _part(rows, _PAIRS)
        place = np.repeat(np.arange(len(previous)), size)
        pw, pu = pw[of], previous[place]
        hashes = _pair(pu, pw)
        order = np.argsort(hashes)
        found = _find(hashes[order], _pair(u, w), lambda at, i: (pw[order[at]] == w[i]) & (pu[order[at]] == u[i]))
        seen = found >= 0
        pair = order[found]
        den, back = _backing(_heard(rows))
        at = np.minimum(np.searchsorted(previous, u[~seen]), len(previous) - 1)
        told = seen.copy()
        told[~seen] = previous[at] == u[~seen]
        where = place[pair]
        where[~seen] = at
        more = _more(of, n)
        for k in range(len(samples)):
            t = np.ones(len(n), np.int64)
            t[more] = s.kept[k][0]
            p += np.where(seen, (n[pair] - DISCOUNT_2 * t[pair]) / den[where], 0.0) + back[k][where] * each[k]
        p /= len(samples)
    base = np.log10((c + BASE_ADD) / base_den)
    log = np.log10(np.where(told, p, 1.0))
    log = np.where(seen, log.astype(np.float32).astype(np.float64), log)
    out = _sums_of(keys, doc[told], buckets, np.zeros(told.sum()), c[told] > 0, base[told], log[told])
    rest = np.flatnonzero(~told)
    rest = rest[np.argsort(u[rest])]
    columns = (u[rest], keys[doc[rest]], (c[rest] > 0).astype(np.int64), base[rest], *each[:, rest])
    out += [(i, _REST, 0, [x[a:b] for x in columns], None) for i, a, b in _cuts(u[rest], buckets)]
    return _stripes(passed + out)


def _late(rows: list, buckets: int) -> pa.RecordBatch:
    """Sums by document of the tokens that were dealt by previous word; one that no
    training text holds gives all to its class."""
    dealt = [p for _, kind, _, p in rows if kind == _REST]
    if not dealt:
        return _stripes([])
    u, key, hit, base, *each = (np.concatenate(x) for x in zip(*dealt))
    share = np.ones((len(each), len(u)))
    if any(kind == _BACK for _, kind, _, _ in rows):
        previous, *sums = _part(rows, _BACK)
        _, back = _backing(sums)
        at = np.minimum(np.searchsorted(previous, u), len(previous) - 1)
        share = np.where(previous[at] == u, back[:, at], share)
    return _stripes(_sums_of(*np.unique(key, return_inverse=True), buckets, np.zeros(len(u)), hit, base, np.log10(np.mean(share * np.array(each), 0))))


def _by_document(rows: list) -> pa.RecordBatch:
    """(key, n, hit, b, s): the sums of each document."""
    keys, at = np.unique(np.concatenate([p[0] for *_, p in rows]), return_inverse=True)
    n, hit, b, s = (np.bincount(at, np.concatenate([p[k] for *_, p in rows]), len(keys)) for k in range(1, 5))
    return pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": np.rint(n).astype(np.int64), "hit": np.rint(hit).astype(np.int64),
                                       "b": b, "s": s})


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``score`` is the model's log10 probability of the text and its end;
    ``base_score`` an add-0.1 unigram's. Null and empty texts are one end.
    Repeated rows and null ids are scored each; other columns are not looked at.
    An empty ``train`` leaves the uniform distribution over one unseen word.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    model = fit(train.select(text(text_col).alias("text")), burn_in, samples)
    spark = docs.sparkSession
    least = max(1.0, FREQUENT * model.tokens)
    top = model.seen(model.probabilities(), model.backing(), least).toArrow()  # at most 1 / FREQUENT pairs
    key = _pair(top.column("u").to_numpy(), top.column("w").to_numpy())
    order = np.argsort(key)
    base = np.log10((top.column("c").to_numpy() + BASE_ADD) / model.base_den)
    maybe = np.zeros(1 << 20, bool)
    maybe[key.view(np.uint64) >> np.uint64(44)] = True
    heads = spark.sparkContext.broadcast((key[order], base[order], top.column("s").to_numpy()[order].astype(np.float64), maybe))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    buckets, totals, base_den = model.buckets, model.samples, model.base_den

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, base_log, log, maybe = heads.value
        for w, u, doc, keys in _blocks(x for batch in batches for x in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())):
            pair = _pair(u, w)
            near = np.flatnonzero(maybe[pair.view(np.uint64) >> np.uint64(44)])
            at = np.searchsorted(frequent, pair[near])
            on = at < len(frequent)
            on[on] = frequent[at[on]] == pair[near[on]]
            near, at = near[on], at[on]
            by = lambda x: np.bincount(doc[near], x, len(keys))  # noqa: B023, E731
            out = _sums_of(*np.unique(keys.view(np.uint64), return_inverse=True), buckets, np.bincount(doc, minlength=len(keys)), by(None), by(base_log[at]), by(log[at]))
            far = np.ones(len(w), bool)
            far[near] = False
            far = np.flatnonzero(far)
            far = far[np.argsort(w[far])]
            w, u, doc = w[far], u[far], doc[far]
            for i, a, b in _cuts(w, buckets):
                new = _starts(w[a:b])
                place = np.zeros(len(keys), np.int64)
                place[doc[a:b]] = 1
                here = np.flatnonzero(place)
                place[here] = np.arange(len(here))
                out.append((i, _TOKENS, 0, [w[a:b][new], _sizes(new, b - a), u[a:b], place[doc[a:b]], keys[here].view(np.uint64)], None))
            yield _stripes(out)

    head = stored(rows.select("doc_id", "key"), "heads")
    copies = head.groupBy("key").agg(F.count("*").alias("m"))  # equal rows brought their words each
    known = model.pairs.unionByName(model.seats).unionByName(model.backs.filter(F.col("kind") == _TOLD))
    slices, parts = SLICES if model.tokens >= SLICE_TOKENS else 1, []
    for i in range(slices):
        tail = rows.filter(F.pmod("key", F.lit(slices)) == i).select("key", "text").mapInArrow(deal, _STRIPES)
        met = stored(_by_bucket(known.unionByName(tail), lambda group: _met(group, totals, base_den, buckets)), "met")
        rest = met.filter(F.col("kind") == _REST).unionByName(model.backs.filter(F.col("kind") == _BACK))
        late = _by_bucket(rest, lambda group: _late(group, buckets))
        sums = _by_bucket(met.filter(F.col("kind") == _SUMS).unionByName(late), _by_document, "key long, n long, hit long, b double, s double")
        parts.append(stored(sums, "slice-sums"))  # a key is in one slice
        del tail, rest, late, sums
        _tidy(spark, met)
    sums = parts[0]
    for x in parts[1:]:
        sums = sums.unionByName(x)
    sums = stored(sums.join(copies, "key"), "tail-sums")
    _tidy(spark, *parts, model.pairs, model.seats, model.backs)
    each = lambda c: F.col(c) / F.col("m")
    return head.join(sums, "key", "left").select(
        "doc_id", each("n").cast("long").alias("n_tokens"), each("hit").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), each("b").alias("base_score"), each("s").alias("score"))
