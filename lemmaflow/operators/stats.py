"""Mergeable summaries (maximum, minimum, sum, count, mean, sum of squared deviations) and outlier trimming.

From the published update and merge formulas of Welford (1962) and Chan, Golub and LeVeque (1979). A missing row is
the summary of nothing, the identity of merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["max", "min", "sum", "count", "mean", "sos"]
TYPE = "struct<max:double,min:double,sum:double,count:bigint,mean:double,sos:double>"


def one(x: Column) -> Column:
    """The summary of a single value."""
    x = x.cast("double")
    return F.struct(x.alias("max"), x.alias("min"), x.alias("sum"), F.lit(1).cast("long").alias("count"), x.alias("mean"), F.lit(0.0).alias("sos"))


def update(s: Column, x: Column) -> Column:
    """The summary with one more value; a null summary is that of nothing."""
    n = s["count"] + 1
    step = x - s["mean"]
    mean = s["mean"] + step / n
    more = F.struct(F.greatest(s["max"], x).alias("max"), F.least(s["min"], x).alias("min"), (s["sum"] + x).alias("sum"), n.alias("count"), mean.alias("mean"), (s["sos"] + step * (x - mean)).alias("sos"))
    return F.when(s.isNull(), one(x)).otherwise(more)


def merge(a: Column, b: Column) -> Column:
    """The summary of two summaries' values; null is the identity."""
    n = a["count"] + b["count"]
    gap = b["mean"] - a["mean"]
    both = F.struct(
        F.greatest(a["max"], b["max"]).alias("max"), F.least(a["min"], b["min"]).alias("min"), (a["sum"] + b["sum"]).alias("sum"), n.alias("count"),
        ((a["sum"] + b["sum"]) / n).alias("mean"), (a["sos"] + b["sos"] + gap * gap * a["count"] * b["count"] / n).alias("sos"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def variance(s: Column) -> Column:
    """Sample variance; 0 for fewer than two values."""
    return F.when(s["count"] < 2, 0.0).otherwise(s["sos"] / F.greatest(s["count"] - 1, F.lit(1)))


def std_dev(s: Column) -> Column:
    return F.sqrt(variance(s))


def of_array(xs: Column) -> Column:
    """The summary of an array's values in order; null for an empty array."""
    return F.aggregate(xs, F.lit(None).cast(TYPE), lambda s, x: update(s, x.cast("double")))


def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys..., FIELDS...)``: one hash aggregation with partial sums on the map side. Null values do not count."""
    x = F.col(value).cast("double")
    n = F.count(x)
    out = df.groupBy(*keys).agg(F.max(x).alias("max"), F.min(x).alias("min"), F.sum(x).alias("sum"), n.alias("count"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x) * (n - 1), F.lit(0.0)).alias("sos"))
    return out.where("count > 0")


def merge_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merges summaries by keys: sos = sum(sos) + sum(n * (mean - whole mean)^2).

    Two aggregations, as differences to the whole mean keep the squares small; both combine on the map side.
    """
    whole = parts.groupBy(*keys).agg((F.sum("sum") / F.sum("count")).alias("_mean"))
    p = parts.join(whole, keys) if keys else parts.crossJoin(whole)
    gap = F.col("mean") - F.col("_mean")
    return p.groupBy(*keys).agg(
        F.max("max").alias("max"), F.min("min").alias("min"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.max("_mean").alias("mean"),
        (F.sum("sos") + F.sum(F.col("count") * gap * gap)).alias("sos"),
    ).where("count is not null")


def is_extreme(least: int, s: Column, x: Column) -> Column:
    """Whether ``x`` is beyond three standard deviations of a summary of at least ``least`` values; strictly."""
    width = 3 * std_dev(s)
    return F.coalesce((s["count"] >= least) & ((x > s["mean"] + width) | (x < s["mean"] - width)), F.lit(False))


def trim(least: int, s: Column, x: Column) -> Column:
    """The mean instead of an extreme value, else the value."""
    return F.when(is_extreme(least, s, x), s["mean"]).otherwise(x)


def online_trim(least: int, xs: Column) -> Column:
    """The summary of an array's values in order, each trimmed by the summary of those before it."""

    def step(s: Column, x: Column) -> Column:
        return F.get(F.transform(F.array(trim(least, s, x.cast("double"))), lambda y: update(s, y)), F.lit(0))

    return F.aggregate(xs, F.lit(None).cast(TYPE), step)


def online_trim_rows(df: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """``online_trim`` of each group in the order of ``order``: a sequential fold, parallel by group only.

    A group is one array in one task, as every step needs the one before; use ``streaming`` for unbounded groups.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_x"))))
    folded = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(online_trim(least, F.transform(rows, lambda r: r["_x"])).alias("s"))
    return folded.select(*keys, "s.*")


def struct_of(prefix: str = "") -> Column:
    """The FIELDS columns of a row as one summary."""
    return F.struct(*(F.col(prefix + f).alias(f) for f in FIELDS))


def expand(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., stat, value)``: the seven labelled numbers of each summary."""
    s = struct_of()
    named = {"max": s["max"], "min": s["min"], "mean": s["mean"], "count": s["count"].cast("double"), "sum": s["sum"], "stdDev": std_dev(s), "var": variance(s)}
    pairs = F.array(*(F.struct(F.lit(k).alias("stat"), v.alias("value")) for k, v in named.items()))
    return df.select(*keys, F.inline(pairs))


#: Names in the JSON form.
JSON = {"mx": "max", "mn": "min", "sm": "sum", "cnt": "count", "avg": "mean", "sos": "sos"}


def to_json(s: Column) -> Column:
    return F.to_json(F.struct(*(s[f].alias(j) for j, f in JSON.items())))


def from_json(text: Column) -> Column:
    """The summary of its JSON form; null for anything but an object with all fields."""
    j = F.from_json(text, "mx double, mn double, sm double, cnt bigint, avg double, sos double")
    return F.when(j["cnt"].isNotNull() & j["avg"].isNotNull(), F.struct(*(j[a].alias(f) for a, f in JSON.items())))
