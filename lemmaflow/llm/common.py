"""What several corpus operators share: reading tables, shared scratch tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, parquet, store
from ..sources.tables import scratch_dir as shared_dir

__all__ = ["WORD", "ascii_lower", "by_value", "connected_components", "fresh", "let", "materialize", "row_keys", "running", "shared_dir", "table"]

#: A word of the whitespace-separated kind, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


table = parquet


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale and the other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def row_keys(*columns: str) -> list[Column]:
    """Two 64-bit hashes ``k1``, ``k2`` that name a row by the columns, ids of any type and nulls included.

    Rows equal in all the columns share the key; of others two would have to collide in both hashes.
    """
    parts = [c for n in columns for c in (F.col(n).isNull(), F.col(n))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def running(values: Column, zero: Column, op, block: int = 64) -> Column:
    """For each value of an array, ``op`` folded over ``zero`` and the values before it.

    Two levels, values in blocks and the blocks' sums, so that no long array is appended to value by value: the
    work is the number of values times the block, and not its square.
    """

    def scan(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(xs, state, lambda s, x: F.struct(op(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")))["out"]

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

    def both(blocks: Column) -> Column:
        starts = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero)
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, j: scan(b, F.get(at, j)))))

    return F.when(F.size(values) > 0, let(let(values, cut), both)).otherwise(F.slice(F.array(zero), 1, 0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected graph; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is two aggregations by
    node; stars keep the number of edges from growing and the number of rounds near the logarithm of the
    longest path. Nothing is collected but a count and a checksum of the edges. Nulls are not nodes.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e, path = store(e, "components")

    def state(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node's smaller neighbours, and itself, point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m")))
        e, later = store(small.where("u != v").distinct(), "components")
        discard(e.sparkSession, path)
        path, after = later, state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def by_value(module: str) -> None:
    """Ships the functions of a module with the job, so that executors need no copy of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)
