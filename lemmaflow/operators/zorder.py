"""Clustering by interleaved bits of several keys (Morton order)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A key column and its schedule: its j-th bit from the top comes at priority + j * stride."""

    column: str
    bits: int
    priority: int = 0
    stride: int = 1


def schedule(keys: list[Key]) -> list[tuple[int, int]]:
    """``(key, bit)`` pairs from the most significant place down, by (priority + j * stride, number of the key).

    The order of two keys' bits depends on those two alone, so tables that share keys cluster alike, whatever other
    keys they have.
    """
    slots = [(k.priority + j * k.stride, n, k.bits - 1 - j) for n, k in enumerate(keys) for j in range(k.bits)]
    return [(n, bit) for _, n, bit in sorted(slots)]


def zkey(keys: list[Key]) -> Column:
    """The interleaved key as a bigint; at most 63 bits in all, so that it sorts as a number. Null if a key is null."""
    places = schedule(keys)
    if len(places) > 63:
        raise ValueError("more than 63 bits: take fewer of each key")
    parts = []
    for at, (n, bit) in enumerate(reversed(places)):
        one = F.shiftrightunsigned(F.col(keys[n].column).cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
        parts.append(F.shiftleft(one, at) if at else one)
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def cluster(df: DataFrame, keys: list[Key], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by the key, for writing: min/max statistics of files then prune on each key."""
    z = df.withColumn("_z", zkey(keys))
    z = z.repartitionByRange(partitions, "_z") if partitions else z.repartitionByRange("_z")
    return z.sortWithinPartitions("_z").drop("_z")


def map_columns(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` applied to every column."""
    return df.select(*(f(F.col(f"`{c}`")).alias(c) for c in df.columns))


def traverse_columns(df: DataFrame, f: Callable[[str, Column], Column | None]) -> DataFrame | None:
    """``f`` applied to every column from the left; None for any gives None."""
    out = []
    for c in df.columns:
        r = f(c, F.col(f"`{c}`"))
        if r is None:
            return None
        out.append(r.alias(c))
    return df.select(*out)


def fold_columns(df: DataFrame, f: Callable[[Column, Column], Column], start: Column) -> Column:
    """Right fold over a row's columns, as a column."""
    return reduce(lambda acc, c: f(F.col(f"`{c}`"), acc), reversed(df.columns), start)


def top_k(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k smallest rows: what a heap's repeated extract-min gives; each task keeps k rows."""
    return df.orderBy(*by).limit(k)
