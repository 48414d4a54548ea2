"""SimHash near-duplicate groups, linked through Hamming BK-trees.

Fingerprints are computed in Arrow batches. Two fingerprints at most ``radius``
bits apart, cut into ``radius + 2`` bands, agree on two bands at least; every
pair of bands is therefore a shard key, and a fingerprint meets all its
neighbours in the shards of its own keys. Each shard becomes a BK-tree (children
keyed by their distance to the parent) that is sent to the task holding the
shard's queries; a query follows only edges within ``radius`` of its distance.
A shard with more than ``block`` fingerprints becomes several trees, and every
block of its queries is sent to each of them, so no task holds more than two blocks.
A shard reports a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .components import components

SHINGLE = 3
RADIUS = 2
BLOCK = 20_000
_CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text, as a signed integer; no words: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(w, w[1:], w[2:])]
    else:
        grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)))]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)  # big-endian
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), _CHUNK):
        ones += np.unpackbits(raw[i:i + _CHUNK], axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(grams))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


class BKTree:
    """BK-tree over unsigned 64-bit fingerprints under Hamming distance.

    ``children[n]`` maps an integer distance to the child holding everything at
    that distance from node ``n``. Whole arrays of fingerprints are inserted and
    queried at once: each node sees the queries that reach it as one array.
    """

    def __init__(self, values: np.ndarray):
        self.values: list[np.uint64] = []
        self.index: list[int] = []
        self.children: list[dict[int, int]] = []
        todo = [(np.arange(len(values)), -1, 0)] if len(values) else []
        while todo:
            rows, parent, edge = todo.pop()
            node = len(self.values)
            self.values.append(values[rows[0]])
            self.index.append(int(rows[0]))
            self.children.append({})
            if parent >= 0:
                self.children[parent][edge] = node
            rest = rows[1:]
            if len(rest):
                d = np.bitwise_count(values[rest] ^ values[rows[0]])
                for k in np.unique(d):
                    todo.append((rest[d == k], node, int(k)))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """(positions of the queries, position of the tree value) for all pairs within radius."""
        todo = [(0, np.arange(len(queries)))] if self.values else []
        while todo:
            node, rows = todo.pop()
            d = np.bitwise_count(queries[rows] ^ self.values[node]).astype(np.int64)
            near = rows[d <= radius]
            if len(near):
                yield near, self.index[node]
            for k, child in self.children[node].items():
                on = rows[np.abs(d - k) <= radius]
                if len(on):
                    todo.append((child, on))


def _forest(tree_rows: np.ndarray, query_rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Star edges that connect exactly what the links within radius connect."""
    tree = BKTree(tree_rows)
    values = np.concatenate([tree_rows, query_rows])
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for near, at in tree.within(query_rows, radius):
        a = root(at)
        for q in (near + len(tree_rows)).tolist():
            b = root(q)
            if a != b:
                parent[b] = a
    # union by arrays: the same fingerprint may sit on both sides
    return [(i, r) for i in range(len(values)) if (r := root(i)) != i]


def _link_shards(radius: int):
    """Partition function: rows sorted by shard -> edges of every shard's forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(shard: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            fps = np.concatenate([f for f, _ in shard])
            side = np.concatenate([s for _, s in shard])
            u = fps.view(np.uint64)
            # side 0: the tree's block; 1: queries of another block; a tree's own block also queries it
            tree, other = u[side == 0], u[side == 1]
            queries = other if len(other) else tree
            at = np.concatenate([tree, queries]).view(np.int64)
            found = _forest(tree, queries, radius)
            e = np.array(found, np.int64).reshape(-1, 2)
            out = pd.DataFrame({"u": at[e[:, 0]], "v": at[e[:, 1]]})
            return out[out.u != out.v]

        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for pdf in batches:
            keys = pdf[["combo", "band", "i", "j"]].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            fps, side = pdf["fp"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64)
            bounds = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                key = tuple(keys[a])
                if last is not None and key != last:
                    yield edges(held)
                    held = []
                last = key
                held.append((fps[a:b], side[a:b]))
        if held:
            yield edges(held)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, text_key) of every row; ``text_key`` tells rows of a repeated id apart."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"),
                       F.xxhash64(F.col(text_col)).alias("text_key"))


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``: a spanning set of all
    links of at most ``radius`` bits (every link's ends are connected)."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    bands = [F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(cuts, cuts[1:])]
    keys = F.array(*(F.struct(F.lit(c).alias("combo"),
                              F.shiftleft(bands[x], 32).bitwiseOR(bands[y]).alias("band"))
                     for c, (x, y) in enumerate(combinations(range(n), 2))))
    routed = distinct.select("fp", F.inline(keys))
    full = stored(routed.groupBy("combo", "band").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
    # a shard of several blocks: each pair of blocks meets once, the lower one as the tree
    met = (routed.join(full, ["combo", "band"])
           .withColumn("blocks", F.expr(f"cast(ceil(n / {block}D) as int)"))
           .withColumn("own", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("combo", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                   F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp"))
    shard = ["combo", "band", "i", "j"]
    return (met.repartition(*shard).sortWithinPartitions(*shard, "fp")
            .mapInPandas(_link_shards(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp, root, text_key): a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` bits, ``fingerprint`` 16 hex digits, ``root`` the component's own
    key (never null). Null, empty and blank texts have fingerprint zero, which
    links like any other. A null id is no candidate for the smallest id; a
    component of null ids has a null ``component_id``. Repeated rows count each.
    Other columns of ``docs`` are not looked at. No rows give no rows.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    joined = stored(components(links(distinct, radius, block)), "components")
    rooted = stored(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    known = stored(rooted.join(lowest, "root").select("fp", "root", "component_id"), "known")
    return each.join(known, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", "fp", "root", "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest id
    (nulls last, then the smaller text key); of repeated rows, one."""
    found = stored(near_duplicates(docs, id_col, text_col, **settings), "near-duplicates")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id",
                                                    "text_key")).alias("best"))
    best = best.select("root", "best.doc_id", "best.text_key")
    k_id, k_text, k_n = (free_name(docs, x) for x in ("kept_id", "kept_text", "kept_n"))
    kept = stored(found.alias("f").join(best.alias("b"), F.expr(
        "f.root = b.root and f.doc_id <=> b.doc_id and f.text_key = b.text_key"))
        .groupBy("f.root", "f.doc_id", "f.text_key").agg(F.count("*").alias(k_n))
        .select(F.col("doc_id").alias(k_id), F.col("text_key").alias(k_text), k_n), "kept")
    on = [F.col(id_col).eqNullSafe(F.col(k_id)), F.xxhash64(F.col(text_col)) == F.col(k_text)]
    once = docs.join(kept.filter(f"{k_n} = 1"), on, "left_semi")
    twice = docs.join(kept.filter(f"{k_n} > 1"), on, "left_semi")
    row = free_name(docs, "row")
    again = (twice.groupBy(F.col(id_col).alias(k_id), F.xxhash64(F.col(text_col)).alias(k_text))
             .agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row)).select(f"{row}.*"))
    return once.unionByName(again)
