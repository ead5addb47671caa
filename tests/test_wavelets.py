"""Haar sketches against direct sums."""

import random

import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import wavelets


def test_full_sketch_is_exact(spark):
    rng = random.Random(1)
    values = [(rng.randrange(16), rng.randrange(1, 9)) for _ in range(60)]
    df = spark.createDataFrame([*values, (None, 5), (99, 1)], "k int, v bigint")
    c = wavelets.coefficients(df, "k", 4, F.col("v"))
    ranges = [(0, 16), (3, 4), (5, 11), (15, 16), (7, 7)]
    got = {(r.lo, r.hi): r.estimate for r in wavelets.estimate_ranges(wavelets.keep_largest(c, 99, 4), spark.createDataFrame(ranges, "lo bigint, hi bigint"), 4).collect()}
    assert got == {(a, b): pytest.approx(sum(v for k, v in values if a <= k < b)) for a, b in ranges}
    few = wavelets.keep_largest(c, 2, 4)
    assert few.count() <= 3
    whole = wavelets.estimate_ranges(few, spark.createDataFrame([(0, 16)], "lo bigint, hi bigint"), 4).first().estimate
    assert whole == pytest.approx(sum(v for _, v in values))


def test_errors(spark):
    x, y, zero = F.lit(8.0), F.lit(10.0), F.lit(0.0)
    r = spark.range(1).select(wavelets.e_abs(x, y), wavelets.e_rel(x, y), wavelets.e_comb(1.0, 1.0, x, y), wavelets.e_comb(0.5, 9.0, x, zero), wavelets.e_rel(x, zero)).first()
    assert tuple(r) == (2.0, 0.2, 0.2, 4.0, None)


def test_max_sketch(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 9.0), (1, 3.0), (3, 7.0)], "k int, v double")
    got = {(r.level, r.block): (r["max"], r.delta) for r in wavelets.max_sketch(df, "k", 2, F.col("v")).collect()}
    assert got[(1, 0)] == (9.0, 5.0) and got[(2, 0)] == (9.0, -2.0) and got[(1, 1)] == (7.0, None) and got[(0, 3)] == (7.0, None)
