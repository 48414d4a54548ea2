"""Near-duplicate vectors by cosine, through dual traversals of cover trees.

1. Equal vectors become one class with a number of rows; classes are scaled to
   unit length, where cosine >= t is chord distance <= sqrt(2 - 2 t).
2. Cells: pivots spread over a bounded sample; each class belongs to its nearest
   pivot's cell and visits a later cell only if the distance to that cell's pivot
   leaves room for a link. Cells and visits are cut into blocks of a bounded size.
3. Every pair of blocks of a cell meets in one group. Each block becomes a cover
   tree: nested levels, radii halved from level to level, every node with its
   real covering radius. Both trees are descended together: a node pair whose
   covering radii keep it beyond the threshold is pruned, one that they keep
   within it is linked as a whole (counted by size, not listed), the others go
   one level down, until single vectors are compared by their cosine.
4. Counts are summed by class; each group's links leave as a forest, whose
   components are joined over all groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.95
BLOCK = 8192  # vectors of one tree
LEAF = 24
SMALL = 256  # vector pairs below a node pair that are compared at once
CELLS = 1024  # most pivots
SAMPLE = 8192  # rows that pivots are chosen from, about
_SLACK = 1e-7  # rounding of a chord distance


def _chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class Node:
    """A node's children: their centers, covering radii, and ranges of the tree's order."""

    __slots__ = ("centers", "radius", "low", "high", "nodes")

    def __init__(self, centers, radius, low, high, nodes):
        self.centers, self.radius, self.low, self.high, self.nodes = centers, radius, low, high, nodes


class CoverTree:
    """Cover tree over unit vectors; ``order`` lists the rows so that every node is a range."""

    def __init__(self, units: np.ndarray, leaf: int = LEAF):
        self.units, self._leaf = units, leaf
        n = len(units)
        self.order = np.empty(n, np.int64)
        self._filled = 0
        self.root = None  # a node whose only child is the whole tree
        if n:
            radius = float(_chord(units @ units[0]).max()) if n > 1 else 0.0
            one = np.ones(1, np.int64)
            self.root = Node(units[:1], radius * np.ones(1), 0 * one, n * one, [self._grow(np.arange(n), radius)])
        self.units = units[self.order]

    def _net(self, rows: np.ndarray, radius: float) -> tuple[list[int], np.ndarray]:
        """Centers further apart than ``radius``, the first row among them, and each row's center."""
        v = self.units[rows]
        centers: list[int] = []
        owner = np.full(len(rows), -1)
        left = np.arange(len(rows))
        least = 1.0 - radius * radius / 2  # cosine at that chord
        while len(left):
            some = left[:256]
            near = v[some] @ v[some].T >= least
            free = np.ones(len(some), bool)
            new = []
            for i in range(len(some)):
                if free[i]:
                    new.append(i)
                    free &= ~near[i]
                    free[i] = False
            chosen = some[new]
            dots = v[left] @ v[chosen].T
            best = dots.argmax(1)
            taken = dots[np.arange(len(left)), best] >= least
            place = np.searchsorted(left, chosen)
            taken[place] = True
            best[place] = np.arange(len(chosen))
            owner[left[taken]] = len(centers) + best[taken]
            centers.extend(chosen.tolist())
            left = left[~taken]
        return centers, owner

    def _grow(self, rows: np.ndarray, radius: float) -> Node:
        """Depth is bounded: the radius halves and stops at 1e-6."""
        if len(rows) <= self._leaf or radius < 1e-6:
            low = np.arange(self._filled, self._filled + len(rows))
            self.order[low] = rows
            self._filled += len(rows)
            return Node(self.units[rows], np.zeros(len(rows)), low, low + 1, [None] * len(rows))
        centers, owner = self._net(rows, radius / 2)
        if len(centers) == 1:
            return self._grow(rows, radius / 2)
        by = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[by], np.arange(len(centers) + 1))
        radii, low, high, nodes = np.zeros(len(centers)), np.empty(len(centers), np.int64), np.empty(len(centers), np.int64), []
        for c, first in enumerate(centers):
            mine = rows[by[cut[c]:cut[c + 1]]]
            low[c] = self._filled
            if len(mine) == 1:
                self.order[self._filled] = mine[0]
                self._filled += 1
                nodes.append(None)
            else:
                own = rows[first]
                mine = np.concatenate([[own], mine[mine != own]])  # nested: the center is its own first child
                radii[c] = float(_chord(self.units[mine] @ self.units[own]).max())
                nodes.append(self._grow(mine, radius / 2))
            high[c] = self._filled
        return Node(self.units[rows[centers]], radii, low, high, nodes)


class Links:
    """Links found between ranges of numbered vectors: weighted counts and components."""

    def __init__(self, weight: np.ndarray):
        n = len(weight)
        self.root = np.arange(n)
        self._count = np.zeros(n + 1, np.int64)
        self._whole = np.zeros(n + 1, np.int64)  # ranges that one link joins as a whole
        self._inside = np.zeros(n + 1, np.int64)  # ranges linked within themselves
        self._before = np.concatenate([[0], np.cumsum(weight)])
        self._weight = weight
        self._edges: list[np.ndarray] = []
        self._held = 0

    def _join(self, low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(self._whole, low, 1)
        np.add.at(self._whole, high - 1, -1)

    def across(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        """Every vector of each range in ``a`` is linked to every vector of its partner in ``b``."""
        (al, ah), (bl, bh) = a, b
        for low, high, other in ((al, ah, self._before[bh] - self._before[bl]), (bl, bh, self._before[ah] - self._before[al])):
            np.add.at(self._count, low, other)
            np.add.at(self._count, high, -other)
            self._join(low, high)
        self._edges.append(np.stack([al, bl]))
        self._held += len(al)
        if self._held > 1 << 20:
            self._settle()

    def within(self, low: np.ndarray, high: np.ndarray) -> None:
        """All vectors of each range are linked to each other."""
        size = self._before[high] - self._before[low]
        np.add.at(self._count, low, size)
        np.add.at(self._count, high, -size)
        np.add.at(self._inside, low, 1)
        np.add.at(self._inside, high, -1)
        self._join(low, high)

    def _settle(self) -> None:
        """Fold the held edges into ``root``: the smallest vector of each component."""
        joined = np.flatnonzero(np.cumsum(self._whole[:-1]) > 0)
        u, v = np.concatenate([*self._edges, np.stack([joined, joined + 1])], axis=1)
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                break
            u, v = u[apart], v[apart]
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        self._edges, self._held = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows linked to each vector without its own class, root of each vector)."""
        self._settle()
        return np.cumsum(self._count[:-1]) - np.cumsum(self._inside[:-1]) * self._weight, self.root


def _compare(one: CoverTree, two: CoverTree, a: Node, b: Node, i: np.ndarray, j: np.ndarray, base: int,
             links: Links, threshold: float) -> None:
    """Compare all vectors below children ``i`` of ``a`` with those below their partners ``j`` of ``b``."""
    na, nb = a.high[i] - a.low[i], b.high[j] - b.low[j]
    each = np.cumsum(na * nb)
    for start, end in zip(range(0, len(i), 512), range(512, len(i) + 512, 512)):  # at most 512 * SMALL pairs
        x, y, w = na[start:end], nb[start:end], (na * nb)[start:end]
        k = np.arange(w.sum()) - np.repeat(each[start:end] - w - (each[start - 1] if start else 0), w)
        p = np.repeat(a.low[i[start:end]], w) + k // np.repeat(y, w)
        q = np.repeat(b.low[j[start:end]], w) + k % np.repeat(y, w)
        hit = np.einsum("ij,ij->i", one.units[p], two.units[q]) >= threshold
        p, q = p[hit], q[hit] + base
        if len(p):
            links.across((p, p + 1), (q, q + 1))


def traverse(one: CoverTree, two: CoverTree | None, links: Links, threshold: float) -> None:
    """Dual traversal of two trees (numbered one after the other), or of one with itself."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    base = len(one.units) if two is not None else 0
    other = one if two is None else two
    todo = [(one.root, other.root)]
    while todo:
        a, b = todo.pop()
        if a is None or b is None:
            continue
        own = two is None and a is b
        for start in range(0, len(a.centers), 256):
            rows = slice(start, start + 256)
            dots = a.centers[rows] @ b.centers.T
            far = a.radius[rows, None] + b.radius[None]
            single = far == 0
            chord = _chord(dots)
            hit = np.where(single, dots >= threshold, chord + far <= reach - _SLACK)
            open_ = ~hit & ~single & (chord - far <= reach + _SLACK)
            if own:  # each unordered pair once; a child with itself below
                later = np.arange(len(b.centers))[None] > np.arange(start, start + len(dots))[:, None]
                hit &= later
                open_ &= later
            i, j = np.nonzero(hit)
            if len(i):
                i = i + start
                links.across((a.low[i], a.high[i]), (b.low[j] + base, b.high[j] + base))
            i, j = np.nonzero(open_)
            i = i + start
            small = (a.high[i] - a.low[i]) * (b.high[j] - b.low[j]) <= SMALL
            _compare(one, other, a, b, i[small], j[small], base, links, threshold)
            todo.extend((a.nodes[x] or _lone(a, x), b.nodes[y] or _lone(b, y)) for x, y in zip(i[~small], j[~small]))
        if own:
            many = np.flatnonzero(a.high - a.low > 1)
            tight = 2 * a.radius[many] <= reach - _SLACK
            links.within(a.low[many[tight]], a.high[many[tight]])
            todo.extend((a.nodes[i], a.nodes[i]) for i in many[~tight])


def _lone(node: Node, i: int) -> Node:
    """A node whose only child is the single vector ``i`` of ``node``."""
    at = slice(i, i + 1)
    return Node(node.centers[at], node.radius[at], node.low[at], node.high[at], [None])


def _units(column: pa.Array) -> np.ndarray:
    v = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _meet(threshold: float):
    """Group function: the blocks of one group -> (class, linked rows, root class)."""

    def run(table: pa.Table) -> pa.Table:
        one = np.asarray(table.column("side").to_numpy()) == 0
        parts = [p for side in (one, ~one) if (p := table.filter(pa.array(side))).num_rows]
        trees = [CoverTree(_units(p.column("v").combine_chunks())) for p in parts]
        out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        apart = table.column("both")[0].as_py()
        if not trees or (apart and len(trees) < 2):
            return out.empty_table()
        ids, weight = (np.concatenate([p.column(c).to_numpy()[t.order] for p, t in zip(parts, trees)]) for c in ("node", "rows"))
        links = Links(weight)
        traverse(trees[0], trees[1] if apart else None, links, threshold)
        count, root = links.result()
        pick = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        return pa.table([pa.array(x[pick]) for x in (ids, count, ids[root])], schema=out)

    return run


def usable(vector: Column) -> Column:
    """The vector is not null or empty, and all components are finite and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _spread(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` pivots of the sample, each as far as possible from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        nxt = int(near.argmin())
        if near[nxt] >= 1 - 1e-12:
            break
        chosen.append(nxt)
        near = np.maximum(near, sample @ sample[nxt])
    return sample[chosen]


def _cells(classes: DataFrame, pivots, reach: float) -> DataFrame:
    """Every class with its cell, its distance to that pivot, and all distances that matter."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                p = shared.value[int(dim)]
                d = _chord(_units(mine.column("v")) @ p.T)
                home = d.argmin(1)
                away = d[np.arange(len(home)), home]
                # a partner in cell c is nearer to pivot c than to this one's pivot
                near = (d <= (away + 2 * reach + _SLACK)[:, None]) & (np.arange(len(p)) > home[:, None])
                i, c = np.nonzero(near)
                others = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(near.sum(1))]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c), pa.array(d[i, c])], ["cell", "away"]))
                yield pa.RecordBatch.from_arrays([mine.column("node"), mine.column("dim"), pa.array(home), pa.array(away), others],
                                                 names=["node", "dim", "cell", "away", "others"])

    return classes.select("node", "dim", "v").mapInArrow(
        run, "node long, dim int, cell long, away double, others array<struct<cell: long, away: double>>")


def _linked(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root): of each class that has links to other classes, by group."""
    spark = classes.sparkSession
    reach = math.sqrt(2 - 2 * threshold)
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    share = SAMPLE / max(1, sum(sizes.values()))
    some = classes.filter(F.xxhash64("node", F.lit(3)) / 2.0 ** 64 + 0.5 <= share).select("dim", "v").toArrow()  # about SAMPLE rows
    pivots = {}
    for dim, n in sizes.items():
        mine = some.filter(pc.equal(some["dim"], dim))["v"].combine_chunks()
        # any unit vector can be a pivot
        pivots[dim] = _spread(_units(mine), min(CELLS, -(-n // block))) if len(mine) else np.eye(1, dim)
    placed = stored(_cells(classes, pivots, reach), "cells")
    radius = placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))  # at most CELLS a length
    home = placed.select("node", "dim", "cell")
    visits = (placed.select("node", "dim", F.explode("others").alias("o"))
              .select("node", "dim", F.col("o.cell").alias("cell"), F.col("o.away").alias("away"))
              .join(F.broadcast(radius.drop("n")), ["dim", "cell"])
              .filter(F.col("away") <= F.col("radius") + reach + _SLACK).select("node", "dim", "cell"))
    visits = stored(visits, "visits")
    blocks = lambda n: F.ceil(F.col(n) / block)
    plan = (radius.select("dim", "cell", blocks("n").alias("homes"))
            .join(visits.groupBy("dim", "cell").agg(F.count("*").alias("m")), ["dim", "cell"], "left")
            .select("dim", "cell", "homes", F.coalesce(blocks("m"), F.lit(0)).alias("guests")))
    plan = F.broadcast(stored(plan, "cell-sizes"))
    cut = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    # a home block meets itself, each later home block and each block of visitors
    home = home.join(plan, ["dim", "cell"]).withColumn("b", cut(F.col("homes"), 11))
    # (partners b .. homes - 1 are home blocks, homes .. homes + guests - 1 blocks of visitors)
    left = home.select("node", "dim", "cell", F.lit(0).alias("side"), F.explode(F.expr(
        "transform(sequence(b, homes + guests - 1), x -> named_struct('i', b, 'j', x))")).alias("g"))
    right = home.filter("b > 0").select("node", "dim", "cell", F.lit(1).alias("side"), F.explode(F.expr(
        "transform(sequence(0L, b - 1), x -> named_struct('i', x, 'j', b))")).alias("g"))
    guest = visits.join(plan, ["dim", "cell"]).withColumn("b", cut(F.col("guests"), 13)).select(
        "node", "dim", "cell", F.lit(1).alias("side"), F.explode(F.expr(
            "transform(sequence(0L, homes - 1), x -> named_struct('i', x, 'j', homes + b))")).alias("g"))
    keys = ["node", "dim", "cell", "side", "g.i", "g.j"]
    met = left.select(*keys).union(right.select(*keys)).union(guest.select(*keys))
    met = met.withColumn("both", F.col("i") != F.col("j")).join(classes.select("node", "rows", "v"), "node")
    return stored(met.groupBy("dim", "cell", "i", "j").applyInArrow(
        _meet(threshold), "node long, links long, root long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision, is at
    least ``threshold`` (over 0). ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable by links, ``kept`` says that it
    is the row's own.

    Vectors that are null, empty, zero or hold a null or non-finite component, and
    vectors of different lengths, do not link. Repeated rows count each, and rows
    with equal ids are different rows. A null id links like any other but is never
    a component's id while another id is reachable; such a row is not kept. Other
    columns are not looked at; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    ok = usable(F.col("v"))
    rows = rows.withColumn("v", F.when(ok, F.col("v"))).select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"),
                       F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v", F.size("v"))).alias("k2"))
    classes = (rows.filter("v is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("rows"),
                                                                    F.min("vec_id").alias("least"))
               .select("*", F.size("v").alias("dim")))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = _linked(classes, threshold, block)
    forest = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (classes.select("node", "k1", "k2", "rows", "least").join(counts, "node", "left").join(forest, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    known = stored(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("k1", "k2", F.expr("rows - 1 + coalesce(links, 0)").alias("n_links"), "component_id")
    out = rows.select("vec_id", "k1", "k2").filter("k1 is not null").join(known, ["k1", "k2"])
    out = out.select("vec_id", "n_links", "component_id").union(
        rows.filter("k1 is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

