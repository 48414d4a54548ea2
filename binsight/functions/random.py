"""Partition-independent pseudo-random columns.

A draw is a function of ``(id, salt, seed)`` alone, never of partitioning or
task order, so a job gives the same rows on 1 or 1000 executors and after a
retry. The three numbers are written out as text and hashed with MD5; the first
13 hex digits are the draw. Another seed or salt is therefore an unrelated
sequence, ids of all 64 bits differ, and any engine with MD5 gives the same.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 52  # 13 hex digits: exact as a double


def _draw(idc, salt: int, seed: int) -> Column:
    idc = F.col(idc) if isinstance(idc, str) else idc
    text = F.concat_ws(":", idc.cast("long").cast("string"), F.lit(str(salt)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(idc, salt: int, seed: int = 0) -> Column:
    """u in [0, 1) from an integer id column (a name or a Column)."""
    return _draw(idc, salt, seed) / F.lit(float(_RANGE))


def uniform_int(n: int, idc, salt: int, seed: int = 0) -> Column:
    """Integer in [0, n) (``n`` far below 2**52)."""
    return F.pmod(_draw(idc, salt, seed), F.lit(n))


def uniform_choice(values: list, idc, salt: int, seed: int = 0) -> Column:
    """Uniform pick from a fixed list (strings, numbers or structs)."""
    arr = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.element_at(arr, (uniform_int(len(values), idc, salt, seed) + 1).cast("int"))


def cumulative_bounds(weights: list[float]) -> list[float]:
    """Upper bounds of the normalised cumulative weights, exact until the last rounding."""
    total = sum(Fraction(w) for w in weights)
    acc, out = Fraction(0), []
    for w in weights:
        acc += Fraction(w)
        out.append(float(acc / total))
    out[-1] = 1.0
    return out


def weighted_choice(values: list[str], weights: list[float], u) -> Column:
    """First value whose cumulative normalised weight exceeds ``u``."""
    u = F.col(u) if isinstance(u, str) else u
    bounds = cumulative_bounds(weights)
    expr = None
    for v, b in zip(values, bounds):
        expr = F.when(u < F.lit(b), F.lit(v)) if expr is None else expr.when(u < F.lit(b), F.lit(v))
    return expr.otherwise(F.lit(values[-1]))
