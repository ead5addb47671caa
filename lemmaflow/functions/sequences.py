"""Rank and select on array columns, any element type.

Positions for rank are 0-based and half open; select gives 1-based positions. Beyond both ends every position
counts as a match: ``rank(i) = i`` for i <= 0, ``select(k) = k`` for k <= 0, and past the last occurrence
``select(k) = n + k - total``. Null elements match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank(x: Column, xs: Column, i: Column) -> Column:
    """Occurrences of ``x`` in positions [0, i)."""
    n = F.size(xs)
    inside = F.least(i, n)
    hits = F.size(F.filter(F.slice(xs, F.lit(1), F.greatest(inside, F.lit(0)).cast("int")), lambda v: v == x))
    return F.when(i <= 0, i).otherwise(hits + (i - inside)).cast("long")


def delta_rank(x: Column, xs: Column, i: Column, j: Column) -> Column:
    """Occurrences in positions [i, j)."""
    return rank(x, xs, j) - rank(x, xs, i)


def select(x: Column, xs: Column, k: Column) -> Column:
    """1-based position of the k-th occurrence."""
    at = F.filter(F.transform(xs, lambda v, i: F.when(v == x, i + 1)), lambda p: p.isNotNull())
    total = F.size(at)
    return F.when(k <= 0, k).when(k > total, F.size(xs) + k - total).otherwise(F.get(at, (k - 1).cast("int"))).cast("long")


def size(xs: Column) -> Column:
    return F.size(xs)
