"""Exact top-k inner products with KD-trees over shards.

Every partition of the candidates is cut into shards of a bounded number of
vectors; each shard becomes a KD-tree with median splits and tight bounding
boxes. A query goes best-first through the boxes by the largest inner product
that a box allows and stops when no box can beat its k-th score. That k-th score
starts from a search of a small sample and is carried from shard to shard, so
later shards are cut off early and few rows leave a task. Queries are broadcast
in blocks of a fixed size.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

K = 10
SHARD = 8192  # vectors of one tree
LEAF = 64
QUERY_BLOCK = 4096  # queries broadcast at once
SAMPLE = 8192  # candidates that give the first bound, about


class KDTree:
    """Median splits of the widest side; nodes keep the tight box and the smallest id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, np.ndarray | None, int, int]] = []
        self._leaf = leaf
        if len(ids):
            self._grow()

    def _grow(self) -> None:
        todo = [(np.arange(len(self.ids)), -1, 0)]
        links: list[list[int]] = []
        rows: list = []
        while todo:
            at, parent, side = todo.pop()
            v = self.vectors[at]
            low, high = v.min(0), v.max(0)
            node = len(rows)
            links.append([-1, -1])
            if parent >= 0:
                links[parent][side] = node
            wide = int((high - low).argmax()) if v.shape[1] else 0
            flat = not v.shape[1] or high[wide] == low[wide]
            rows.append((low, high, int(self.ids[at].min()), at if len(at) <= self._leaf or flat else None))
            if rows[-1][3] is None:
                half = len(at) // 2
                part = np.argpartition(v[:, wide], half)
                todo.append((np.sort(at[part[:half]]), node, 0))
                todo.append((np.sort(at[part[half:]]), node, 1))
        self.nodes = [(*r, *links[i]) for i, r in enumerate(rows)]
        self.low = np.array([r[0] for r in rows])
        self.high = np.array([r[1] for r in rows])

    def search(self, query: np.ndarray, own: int, best: list[tuple[int, int]], k: int, floor: int | None) -> None:
        """Improve ``best``, a heap of (score, -id) of at most ``k`` entries.

        ``floor`` is a score that k candidates are known to reach. A row with the
        id ``own`` is no candidate. Ties go to the smaller id.
        """
        if not self.nodes:
            return
        # the largest inner product a box allows, for all boxes at once
        bound = np.maximum(self.low * query, self.high * query).sum(1)
        todo = [(-bound[0], 0)]
        while todo:
            b, node = heapq.heappop(todo)
            _, _, least, at, left, right = self.nodes[node]
            if floor is not None and -b < floor:
                return
            if len(best) == k:
                if -b < best[0][0]:
                    return
                if -b == best[0][0] and least > -best[0][1]:
                    continue
            if at is None:
                heapq.heappush(todo, (-bound[left], left))
                heapq.heappush(todo, (-bound[right], right))
                continue
            scores = self.vectors[at] @ query
            cut = best[0][0] if len(best) == k else (floor if floor is not None else -np.inf)
            near = np.flatnonzero((scores >= cut) & (self.ids[at] != own))
            if len(near) > k:
                near = near[np.lexsort((self.ids[at][near], -scores[near]))[:k]]
            for i in near:
                entry = (int(scores[i]), -int(self.ids[at[i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of every component, as bigint; null unless all are finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024)))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, np.float64) for v in column.to_pylist()]


def _check(largest: float, query: np.ndarray) -> None:
    if largest * np.abs(query).max(initial=0) * query.size >= 2.0 ** 53:
        raise ValueError("scores beyond 2^53 are not exact")


def _search(queries, k: int):
    """Partition function: candidates -> each block query's best of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value  # (position, id, vector, floor)
        best: dict[int, list] = defaultdict(list)
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))

        def flush(dim: int) -> None:
            ids, vectors = held.pop(dim)
            rows = np.array(vectors).reshape(len(ids), dim)
            tree = KDTree(rows, np.array(ids, np.int64))
            largest = float(np.abs(rows).max(initial=0))
            for n, qid, q, floor in asked:
                if len(q) == dim:
                    _check(largest, q)
                    tree.search(q, qid, best[n], k, floor)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), _matrix(batch.column("v"))):
                ids, vectors = held[len(v)]
                ids.append(i)
                vectors.append(v)
                if len(ids) >= SHARD:
                    flush(len(v))
        for dim in list(held):
            flush(dim)
        rows = [(n, -i, s) for n, heap in best.items() for s, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["n", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the
    largest inner product with each row of ``queries``, all if there are fewer.

    Components become floor(1024 * x). Rows whose vector is null or holds a null
    or non-finite component, and rows with a null id, take no part; vectors of
    different lengths do not meet; a row with the query's id is its own and no
    candidate. Equal scores go to the smaller id. Repeated candidate rows count
    each; repeated queries are asked once. Without queries there are no rows.
    Scores of 2^53 or more raise ValueError.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = stored(usable(vectors), "vectors")
    asked = stored(usable(queries).distinct().withColumn("n", F.monotonically_increasing_id()), "queries")
    n_rows, n_asked = rows.count(), asked.count()
    blocks = -(-n_asked // query_block)
    share = min(1.0, SAMPLE / n_rows) if n_rows else 1.0
    pilot = rows.filter((F.xxhash64("id", "v") / 2.0 ** 64 + 0.5) <= share)
    out = []
    for b in range(blocks):
        # hashed blocks differ a little in size
        block = [(r["n"], r["id"], np.array(r["v"], np.float64))
                 for r in asked.filter(F.expr(f"pmod(xxhash64(n), {blocks}) = {b}")).collect()]
        floors: dict[int, int] = {}
        if share < 1:
            first = spark.sparkContext.broadcast([(*q, None) for q in block])
            known = _ranked(pilot.mapInArrow(_search(first, k), "n long, vec_id long, score long"), k)
            floors = {r["n"]: r["score"] for r in known.filter(F.col("rank") == k).select("n", "score").collect()}
        shared = spark.sparkContext.broadcast([(n, i, v, floors.get(n)) for n, i, v in block])
        out.append(stored(_ranked(rows.mapInArrow(_search(shared, k), "n long, vec_id long, score long"), k), "best"))
    found = spark.createDataFrame([], "n long, vec_id long, score long, rank int")
    for part in out:
        found = found.unionByName(part)
    return found.join(asked.select("n", F.col("id").alias("query_id")), "n").select("query_id", "rank", "vec_id", "score")
