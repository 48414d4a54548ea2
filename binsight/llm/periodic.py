"""Runs of periodically repeated words, by longest common extensions on a harmonic grid.

A run of period q and length L is a stretch of L - q positions i at which word i
equals word i + q. With L >= least(q) every such stretch holds a multiple of
least(q) - q, so only those positions are looked at for q (the grid: about
n ln(n) / 3 positions for all periods together). At a grid position with equal
words the stretch is extended to both sides by a longest common extension (LCE)
of the two suffixes, and of the two prefixes in the reversed text.

An LCE compares a few words until both positions lie in a difference cover
modulo 31 (30 words at most), then reads the rest off the sorted suffixes of the
covered positions: their common prefix is a range minimum in a sparse table.
Those suffixes are sorted by prefix doubling over names of 31 words, and only if
some extension gets that far.

Every text is looked at on its own, whole, by one task: memory is about 40 bytes
a word and table level, in blocks of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import words

#: A perfect difference set; every difference modulo 31 occurs between two members.
COVER_MOD = 31
COVER = (0, 1, 3, 8, 12, 18)
FEWEST_WORDS = 6  # of a run
FEWEST_TURNS = 4  # periods in a run
GRID_BLOCK = 1 << 20  # grid positions held at once


def _shift_table() -> np.ndarray:
    """[i mod 31, (j - i) mod 31] -> words to go until both positions are covered."""
    inside = np.isin(np.arange(COVER_MOD), COVER)
    i, gap, k = np.ogrid[:COVER_MOD, :COVER_MOD, :COVER_MOD]
    return (inside[(i + k) % COVER_MOD] & inside[(i + gap + k) % COVER_MOD]).argmax(2)


_SHIFT = _shift_table()


class Lce:
    """Longest common extensions to the right in a sequence of small integers."""

    def __init__(self, ids: np.ndarray):
        self.n, self.ids = len(ids), ids
        self._sorted = False

    def _same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words i and j (i < j) exist and are equal."""
        ok = j < self.n
        last = self.n - 1
        return ok & (self.ids[np.minimum(i, last)] == self.ids[np.minimum(j, last)])

    def _sort(self) -> None:
        """Ranks of the covered suffixes and a sparse table over their common prefixes."""
        n, v = self.n, COVER_MOD
        # covered positions class by class, so that position + 31 is the next entry
        at = np.concatenate([np.arange(c, n, v) for c in COVER])
        ends = np.cumsum([len(range(c, n, v)) for c in COVER]) - 1
        follows = np.ones(len(at), bool)
        follows[ends[ends >= 0]] = False
        self._entry = np.full(n, -1, np.int64)
        self._entry[at] = np.arange(len(at))
        # names of the 31 words at each position, by doubling; zeros follow the text
        names = np.concatenate([self.ids + 1, np.zeros(v, np.int64)])
        size = 1
        while size < v:
            wider = min(2 * size, v)
            ahead = np.concatenate([names[wider - size:], np.zeros(wider - size, np.int64)])
            names = np.unique(names * (int(names.max()) + 1) + ahead, return_inverse=True)[1]
            size = wider
        rank = np.unique(names[at], return_inverse=True)[1]
        step, m = 1, len(at)
        stop = np.flatnonzero(~follows)  # entries from here to the end of the class:
        left = stop[np.searchsorted(stop, np.arange(m))] - np.arange(m) + 1
        ladder = [rank]
        while rank.max(initial=0) < m - 1 and step < m:
            after = np.zeros(m, np.int64)
            more = np.flatnonzero(left > step)
            after[more] = rank[more + step] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
            ladder.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        # common prefix of neighbours: whole names down the ladder, then single words
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(ladder) - 1, -1, -1):
            size = 1 << level
            names = ladder[level]
            fits = (a < m) & (b < m)
            eq = fits & (names[np.minimum(a, m - 1)] == names[np.minimum(b, m - 1)])
            # a name that ran past its class is equal only if both ended there, which no two suffixes do
            eq &= (left[np.minimum(a, m - 1)] >= size) & (left[np.minimum(b, m - 1)] >= size)
            common[eq] += size * v
            ended = eq & ((left[np.minimum(a, m - 1)] == size) | (left[np.minimum(b, m - 1)] == size))
            a = np.where(ended, m, np.where(eq, a + size, a))
            b = np.where(ended, m, np.where(eq, b + size, b))
        one, two = np.minimum(at[order[:-1]], at[order[1:]]), np.maximum(at[order[:-1]], at[order[1:]])
        going = np.arange(len(common))
        while len(going):
            going = going[self._same(one[going] + common[going], two[going] + common[going])]
            common[going] += 1
        self._place = np.empty(m, np.int64)
        self._place[order] = np.arange(m)
        self._table = [common.astype(np.int32)]
        while len(self._table[-1]) > (1 << (len(self._table) - 1)):
            t, half = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(t[:-half], t[half:]))
        self._sorted = True

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i < j <= n."""
        out = np.zeros(len(i), np.int64)
        if not len(i):
            return out
        need = _SHIFT[i % COVER_MOD, (j - i) % COVER_MOD]
        live = np.arange(len(i))
        while len(live):
            live = live[out[live] < need[live]]
            live = live[self._same(i[live] + out[live], j[live] + out[live])]
            out[live] += 1
        # those that stand on covered positions with all words before them equal
        far = np.flatnonzero((out == need) & (j + out < self.n))
        far = far[self._same(i[far] + out[far], j[far] + out[far])]
        if not len(far):
            return out
        if not self._sorted:
            self._sort()
        x, y = self._place[self._entry[i[far] + out[far]]], self._place[self._entry[j[far] + out[far]]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)  # minimum over neighbours lo .. hi - 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        rest = np.empty(len(far), np.int64)
        for k in np.unique(level):
            pick = level == k
            t = self._table[k]
            rest[pick] = np.minimum(t[lo[pick]], t[hi[pick] - (1 << int(k))])
        out[far] += rest
        return out


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    n = len(ids)
    none = np.empty(0, np.int64)
    most = n // FEWEST_TURNS
    if n < FEWEST_WORDS:
        return none, none, none
    periods = np.arange(1, most + 1)
    step = np.maximum(FEWEST_WORDS, FEWEST_TURNS * periods) - periods
    points = -(-(n - periods) // step)
    total = np.cumsum(points)
    right, left = Lce(ids), Lce(ids[::-1])
    found: list[np.ndarray] = []
    a = 0
    while a < most:
        # periods whose grid fits into a block; one period alone may exceed it
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + GRID_BLOCK, "right")))
        q = np.repeat(periods[a:b], points[a:b])
        first = np.cumsum(points[a:b]) - points[a:b]
        i = (np.arange(len(q)) - np.repeat(first, points[a:b])) * np.repeat(step[a:b], points[a:b])
        hit = ids[i] == ids[i + q]
        i, q = i[hit], q[hit]
        a = b
        if not len(i):
            continue
        ahead = right.of(i, i + q)
        behind = left.of(n - i - q, n - i)
        start, length = i - behind, behind + ahead + q
        ok = length >= np.maximum(FEWEST_WORDS, FEWEST_TURNS * q)
        if ok.any():
            found.append(np.unique(np.stack([start[ok], length[ok], q[ok]]), axis=1))
    if not found:
        return none, none, none
    # a stretch with several periods counts for the smallest: sorted, the first of each stretch
    start, length, q = np.unique(np.concatenate(found, axis=1), axis=1)
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Place of the run with the greatest exact length / period; ties: smallest start, then period."""
    ratio = length / period
    close = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return int(min(close, key=lambda r: (-Fraction(int(length[r]), int(period[r])), start[r], period[r])))


def _numbered(w: list[bytes]) -> np.ndarray:
    if not w:
        return np.empty(0, np.int64)
    return pa.array(w, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed): the periodic stretches of every row's words.

    Words are runs of bytes that are neither space nor \\x09-\\x0D. A run is a
    stretch of consecutive words with smallest period q, at least 6 words and 4
    periods long, that no neighbouring word extends with period q. ``runs`` holds
    (start, length, period) by start, then period; ``best`` is the run of the
    greatest length / period (ties: smallest start, then period), null without
    runs. ``collapsed`` is the text without the words that stand in some run
    after its first period, joined by one space.

    Null, empty and white texts have no words and no runs; very long texts are
    taken whole, by one task. Rows are independent: repeated rows and repeated
    or null ids are kept as they are; other columns are not looked at; no rows
    give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, all_runs, best, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                n_words.append(len(w))
                start, length, period = runs(_numbered(w))
                each = [{"start": s, "length": n, "period": q}
                        for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())]
                all_runs.append(each)
                best.append(each[strongest(start, length, period)] if each else None)
                if each:
                    change = np.zeros(len(w) + 1, np.int64)
                    np.add.at(change, start + period, 1)
                    np.add.at(change, start + length, -1)
                    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    w = [w[i] for i in keep]
                kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(_RUN)),
                 pa.array(best, _RUN), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"])

    one = "struct<start: long, length: long, period: long>"
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{one}>, best {one}, collapsed string")
