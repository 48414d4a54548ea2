"""Packing token pieces into fixed-size sequences by a configuration linear program.

Documents are tokenised where they lie and cut into pieces; only the histogram
of piece lengths (at most ``capacity`` rows) reaches the driver. There a
covering program over configurations (multisets of lengths that fit into one
sequence) is solved by multiplicative weights, priced by a knapsack dynamic
program; about half of the sequences are rounded from its solution and what is
left is placed best-fit. The
outcome is a short list of segments (length, range of ranks -> sequence,
offset); every piece finds its place from its rank among the pieces of its
length, so no task holds all pieces of a length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
EPSILON = 0.3  # a step covers half of this share of a demand
SLACK = 0.03  # a configuration may be worth this share less than the best
ROUNDED = (0.52, 0.4, 0.25, 0.1)  # shares of the sequences of shared pieces that are tried to come from the program
TOLERANCE = 0.0005  # a larger share may cost this many more sequences
RANK_ROWS = 100_000  # pieces that one task ranks at most, about

# the fast encoder recurses on white space; such texts take the slower one
_LONG_SPACE = re.compile(r"\s{5000}")


@lru_cache(maxsize=4)
def _encoders(name: str):
    """The same vocabulary twice: as ranks for the fast encoder, and as its own file."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    return fast, slow


@lru_cache(maxsize=4)
def _specials(name: str) -> tuple[str, ...]:
    """Texts of the tokenizer's added tokens, which the fast encoder does not know."""
    return tuple(t.content for t in _encoders(name)[1].get_added_tokens_decoder().values())


def token_ids(text: str | None, tokenizer: str = TOKENIZER) -> np.ndarray:
    """Ids of a whole text as the tokenizer's file gives them, with no token added; null is empty."""
    fast, slow = _encoders(tokenizer)
    if not text:
        return np.zeros(0, np.uint32)
    if _LONG_SPACE.search(text) or any(x in text for x in _specials(tokenizer)):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=())


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but perhaps the first."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int,
                   epsilon: float = EPSILON) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional cover of ``demand`` by configurations ((index, count), ...).

    Multiplicative weights: a length's price starts at its share of a sequence and
    falls exponentially with how much of its demand is covered. Each round solves the knapsack for all sizes
    once and applies the configurations, one for each length, whose value is
    within ``SLACK`` of the best, those that fill the capacity if they are; each
    covers ``epsilon / 2`` of the demand of the length it exhausts first. Lengths
    leave once covered.
    """
    m = len(lengths)
    covered = np.zeros(m)
    rate = np.log(m + 1) / epsilon / 16
    found: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        live = np.flatnonzero(covered < 1 - 1e-9)
        if not len(live):
            return found
        size = lengths[live]
        price = np.exp(-rate * (covered[live] - covered[live].min())) * size / capacity
        best = np.full(capacity + 1, -np.inf)  # value of the best configuration of exactly that size
        best[0] = 0
        take = np.full(capacity + 1, -1)
        fits = np.searchsorted(size, np.arange(capacity + 1), "right")
        for w in range(int(size[0]), capacity + 1):
            gain = best[w - size[:fits[w]]] + price[:fits[w]]
            k = int(gain.argmax())
            if gain[k] > -np.inf:
                best[w], take[w] = gain[k], k
        top = int(best.argmax())
        end = capacity if best[capacity] >= (1 - SLACK) * best[top] else top
        value = np.where(size <= end, price + best[np.maximum(end - size, 0)], -np.inf)
        seen = np.zeros(len(live), bool)
        for k in np.argsort(-value, kind="stable"):
            if value[k] < (1 - SLACK) * best[top]:
                break
            if seen[k]:
                continue
            count: dict[int, int] = {int(k): 1}
            w = end - int(size[k])
            while take[w] >= 0:
                count[int(take[w])] = count.get(int(take[w]), 0) + 1
                w -= int(size[take[w]])
            # no configuration may use more of a length than there is
            count = {j: min(c, int(demand[live[j]])) for j, c in count.items()}
            step = min(min(epsilon / 2, 1 - covered[live[j]] + 1e-12) * demand[live[j]] / c for j, c in count.items())
            if step <= 0:
                continue
            key = tuple(sorted((int(live[j]), c) for j, c in count.items()))
            found[key] = found.get(key, 0.0) + step
            for j, c in count.items():
                covered[live[j]] += step * c / demand[live[j]]
                seen[j] = True


def plan(lengths: list[int], counts: list[int], capacity: int = CAPACITY,
         epsilon: float = EPSILON, report: dict | None = None) -> np.ndarray:
    """Segments (length, first rank, end rank, pieces a sequence, first sequence, offset).

    Rows are sorted by (length, first rank) and cover every rank once. The program's
    solution is rounded to several shares of the sequences; the largest share
    stays whose total is within ``TOLERANCE`` of the fewest sequences. ``report``,
    if given, gets the numbers of sequences: of single full pieces, from the
    program, by best fit.
    """
    order = np.argsort(lengths)
    size, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    rest = np.flatnonzero((count > 0) & (size < capacity))
    full: dict[tuple[tuple[int, int], ...], float] = {}
    if len(rest):
        chosen = configurations(size[rest], count[rest].astype(float), capacity, epsilon)
        # one that leaves room would waste it in each of its sequences; its pieces go to best fit
        full = {tuple((int(rest[j]), c) for j, c in config): x for config, x in chosen.items()
                if sum(c * int(size[rest[j]]) for j, c in config) == capacity}
    made = [_layout(size, count, full, capacity, share) for share in ROUNDED]
    fewest = min(sum(r.values()) for _, r in made)
    rows, found = next((rows, r) for rows, r in made if sum(r.values()) <= fewest * (1 + TOLERANCE))
    if report is not None:
        report.update(found)
    return rows


def _layout(size: np.ndarray, count: np.ndarray, full: dict[tuple[tuple[int, int], ...], float], capacity: int,
            share: float) -> tuple[np.ndarray, dict[str, int]]:
    """(segments, report) with ``share`` of the sequences rounded from the solution ``full``."""
    left, used = count.copy(), np.zeros(len(size), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    # equal sequences are kept together: free room -> (items, number of such sequences)
    groups: dict[int, list[tuple[tuple, int]]] = {}
    free = 0

    def put(items: tuple, room: int, times: int) -> None:
        nonlocal free
        if times > 0:
            groups.setdefault(room, []).append((items, times))
            free |= 1 << room

    def place(config: tuple, times: int) -> None:
        nonlocal sequences
        offset = 0
        for j, c in config:
            rows.append((int(size[j]), int(used[j]), int(used[j] + c * times), c, sequences, offset))
            used[j] += c * times
            offset += c * int(size[j])
        sequences += times

    for j in np.flatnonzero(size >= capacity):
        place(((int(j), 1),), int(left[j]))
        left[j] = 0
    report = {"single": sequences}
    # rounded: the whole part of each configuration, then each once more, as far as pieces are left; those
    # of few, long pieces first, so that best fit keeps short ones to fill gaps with
    target = sequences + -int(-share * int((size * left).sum()) // capacity)
    for whole in (True, False):
        for items, x in sorted(full.items(), key=lambda kv: (sum(c for _, c in kv[0]), -kv[1], kv[0])):
            times = min(int(x) if whole else 1, target - sequences, *(int(left[j]) // c for j, c in items))
            if times > 0:
                place(items, times)
                for j, c in items:
                    left[j] -= c * times
    report["program"] = sequences - report["single"]
    # best fit, longest first, of what rounding left
    for j in np.flatnonzero(left > 0)[::-1]:
        s, n = int(size[j]), int(left[j])
        while n:
            above = free >> s
            if above:
                room = s + (above & -above).bit_length() - 1
                items, times = groups[room].pop()
                if not groups[room]:
                    free &= ~(1 << room)
            else:
                room, items, times = capacity, (), n
            c = min(room // s, n)
            use = min(times, n // c)
            put((*items, (int(j), c)), room - c * s, use)
            if items:
                put(items, room, times - use)
            n -= c * use
    for same in groups.values():
        for items, times in same:
            place(items, times)
    report["best_fit"] = sequences - report["single"] - report["program"]
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 6), report


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = np.append(token_ids(text, tokenizer), np.uint32(end_id)).astype("<u4")
                for p, (s, n) in enumerate(cut(len(got), capacity)):
                    at.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(got[s:s + n].tobytes()))
                    if with_ids:
                        ids.append(got[s:s + n].astype(np.int32))
            columns = {"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                       "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         capacity: int = CAPACITY, end_id: int = END_ID, epsilon: float = EPSILON) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``.

    A null or empty text is its end id alone. Null ids stay null, repeated rows
    are packed each, other columns are not looked at; an empty table gives no rows.
    """
    cutting = pieces(docs, id_col, text_col, tokenizer, capacity, end_id)
    cutting = stored(cutting.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = sorted((r["length"], r["n"]) for r in cutting.groupBy("length").agg(F.count("*").alias("n")).collect())
    lengths, counts = [r[0] for r in histogram], [r[1] for r in histogram]
    segments = docs.sparkSession.sparkContext.broadcast(plan(lengths, counts, capacity, epsilon))
    # ranks among equal lengths: numbered inside hashed buckets, then shifted by the buckets before
    buckets = -(-max(counts, default=1) // RANK_ROWS)
    spread = cutting.withColumn("bucket", F.expr(f"pmod(xxhash64(row), {buckets}L)"))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = spread.withColumn("nr", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = (ranked.join(before, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nr") + F.col("before")).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segments.value
        step = int(seg[:, 1].max(initial=0)) + 1  # (length, first rank) as one ascending number
        first = seg[:, 0] * step + seg[:, 1]
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            s = seg[np.searchsorted(first, length * step + np.minimum(rank, step - 1), "right") - 1]
            nth = rank - s[:, 1]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(s[:, 4] + nth // s[:, 3])
            columns["offset"] = pa.array(s[:, 5] + nth % s[:, 3] * s[:, 0])
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")


def token_sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, input_ids): the packed sequences themselves. A sequence holds
    at most ``capacity`` ids, which bounds every group."""
    cutting = pieces(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids=True)
    cutting = cutting.dropDuplicates(["doc_id", "piece", "length", "ids_crc32"]).alias("c")
    on = F.expr("c.doc_id <=> p.doc_id and c.piece = p.piece and c.length = p.length and c.ids_crc32 = p.ids_crc32")
    return (placed.alias("p").join(cutting, on).groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("input_ids")))
