"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v); the minima are stored so that the join's
    two sides are plain shuffles, which adaptive execution can split for a hub."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        near = edges.union(back)
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = stored(near.groupBy("u").agg(F.min("v").alias("low"))
                  .select("u", F.least("u", "low").alias("low")), "star-low")
    joined = near.join(lows, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
               .union(lows.select("u", F.col("low").alias("v"))))
    out = stored(out.filter("u != v").distinct(), "star")
    discard(lows)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: bigint, any direction, repeats allowed) -> (node, root),
    a row for every node of an edge, ``root`` the smallest node it reaches.

    Each pass stores its edges in the shared folder. The passes end when the edge
    set no longer changes; chains contract by a constant factor a pass. An edge
    table without rows, or of self-links only, gives no rows.
    """
    now = stored(edges.select("u", "v").filter("u != v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        wide = _star(now, large=True)
        discard(now)
        now = _star(wide, large=False)
        discard(wide)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
