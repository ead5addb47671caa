"""Haar sketches of values over an integer key (a Morton key, say), for estimates of sums and result sizes.

Keys are 0 to 2^bits - 1. A coefficient ``(level, block)`` stands for the 2^level keys from block * 2^level on: the sum
over its left half less that over its right half, kept exactly as sums; the overall sum has level ``bits`` + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coefficients(df: DataFrame, key: str, bits: int, value: Column | None = None) -> DataFrame:
    """``(level, block, diff)`` of the counts, or the sums of ``value``, by key; zeros are left out.

    Rows are first summed by key; each key then adds to one coefficient a level, combined on the map side.
    """
    k = F.col(key).cast("long")
    one = F.lit(1).cast("long") if value is None else value
    leaves = df.where((k >= 0) & (k < (1 << bits))).groupBy(k.alias("k")).agg(F.sum(one).alias("v"))
    levels = F.sequence(F.lit(1), F.lit(bits + 1))

    def term(level: Column) -> Column:
        left = F.call_function("shiftright", F.col("k"), level - 1).bitwiseAND(F.lit(1).cast("long")) == 0
        return F.struct(level.alias("level"), F.call_function("shiftright", F.col("k"), level).alias("block"), F.when(left | (level > bits), F.col("v")).otherwise(-F.col("v")).alias("diff"))

    each = leaves.select(F.inline(F.transform(levels, term)))
    return each.groupBy("level", "block").agg(F.sum("diff").alias("diff")).where("diff <> 0")


def keep_largest(coefs: DataFrame, most: int, bits: int) -> DataFrame:
    """The overall sum and the ``most`` coefficients with the largest weight |diff| / sqrt(2^level), the best in the 2-norm."""
    top = coefs.where(F.col("level") <= bits).orderBy(F.desc(F.abs("diff") / F.sqrt(F.pow(F.lit(2.0), F.col("level")))), "level", "block").limit(most)
    return coefs.where(F.col("level") > bits).union(top)


def estimate_ranges(sketch: DataFrame, ranges: DataFrame, bits: int) -> DataFrame:
    """``(lo, hi, estimate)`` for ranges ``(lo, hi)``, hi exclusive, within the keys.

    A coefficient adds diff / 2^level for each key of the range in its left half and subtracts it in its right one.
    The sketch has the few coefficients that ``keep_largest`` left, so each range meets all of them.
    """
    r = ranges.select("lo", "hi").distinct().crossJoin(F.broadcast(sketch))  # the sketch is bounded by its parameter
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.least("level", F.lit(bits)))
    start = F.col("block") * width

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least("hi", b) - F.greatest("lo", a), F.lit(0))

    half = F.floor(width / 2).cast("long")
    part = F.when(F.col("level") > bits, overlap(F.lit(0), width)).otherwise(overlap(start, start + half) - overlap(start + half, start + width))
    return r.groupBy("lo", "hi").agg(F.sum(F.col("diff") * part / width).alias("estimate"))


def e_abs(expected: Column, actual: Column) -> Column:
    return F.abs(expected - actual)


def e_rel(expected: Column, actual: Column) -> Column:
    """Relative to the actual value; null where that is 0."""
    return F.when(actual != 0, F.abs(expected - actual) / actual)


def e_comb(alpha: float, beta: float, expected: Column, actual: Column) -> Column:
    """The smaller of the weighted errors; the absolute one where the actual value is 0."""
    a = alpha * e_abs(expected, actual)
    return F.when(actual == 0, a).otherwise(F.least(a, beta * e_rel(expected, actual)))


def max_sketch(df: DataFrame, key: str, bits: int, value: Column) -> DataFrame:
    """``(level, block, max, delta)``: a block's largest value, and how much the right half's is above the left's.

    ``delta`` is null where a half has no value. Level 0 are the keys themselves.
    """
    k = F.col(key).cast("long")
    leaves = df.where((k >= 0) & (k < (1 << bits))).groupBy(k.alias("k")).agg(F.max(value).alias("v"))

    def term(level: Column) -> Column:
        right = F.when(level > 0, F.call_function("shiftright", F.col("k"), F.greatest(level - 1, F.lit(0))).bitwiseAND(F.lit(1).cast("long")) == 1)
        return F.struct(level.alias("level"), F.call_function("shiftright", F.col("k"), level).alias("block"), right.alias("right"), F.col("v").alias("v"))

    each = leaves.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(bits)), term)))
    side = F.max(F.when(F.col("right"), F.col("v"))) - F.max(F.when(~F.col("right"), F.col("v")))
    return each.groupBy("level", "block").agg(F.max("v").alias("max"), side.alias("delta"))
