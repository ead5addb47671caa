"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, materialize, row_keys

#: Most rows of a block of the reduction tree, in the mean. A block is one array in one task.
BLOCK = 128
#: Sources up to which their statistics (a few numbers each, under 100 bytes) are broadcast.
BROADCAST_SOURCES = 50_000
#: Rows of a key and a number (24 bytes) up to which they are broadcast to the texts.
BROADCAST_ROWS = 500_000
#: Copies of one row that are numbered in one array.
COPIES = 10_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``(source, n, source_size, target)``: what each source gives to the mix, in words.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words. A target
    stops at ``cap`` times its source's size and what is over goes to the others by weight. ``n`` counts the rows of
    ``sizes``; a column ``m``, if there is one, says how many documents a row stands for. That ends where
    ``sum(least(cap * size, level * weight))`` is the budget: sources in order of ``cap * size / weight``
    are full up to one point, and prefix sums of caps and suffix sums of weights give the level there.
    """
    alike = F.col("m") if "m" in sizes.columns else F.lit(1)
    s = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * alike).alias("source_size"))
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    s = s.withColumn("full", F.col("source_size") * cap).withColumn("fill", F.col("full") / F.col("weight"))
    everything = Window.partitionBy()
    s = s.withColumn("caps_before", F.coalesce(F.sum("full").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("caps_before")) / F.col("weights_left"))
    s = s.withColumn("is_full", F.col("full") <= F.col("level") * F.col("weight"))
    # once one source has room, all later ones have: their own level is the one of the first
    s = s.withColumn("open_level", F.max(F.when(~F.col("is_full"), F.struct(-F.col("caps_before"), "level"))).over(everything)["level"])
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    return s.select("source", "n", "source_size", target.alias("target"))


def _uniform(*keys) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(2**53))


def _pivot(state: Column, row: Column) -> Column:
    """One duel of the pivotal method: the carried row against the next one.

    ``p`` is the probability of one more copy and ``p * size`` its mass in words. Mass moves from one row to
    the other until one probability is 0 or 1; that row is done. Which way is random, with the odds that
    leave each expectation as it was, so the words of a block never change but for rounding.
    """
    a, b = state["carry"], row
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    to_a = b["u"] * (up + down) < down
    a_first = F.when(to_a, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
    done_value = F.when(to_a == a_first, 1.0).otherwise(0.0)
    moved = F.when(to_a, -up).otherwise(down)  # words that b gains
    left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(a_first, b["p"] + moved / b["size"]).otherwise(a["p"] - moved / a["size"])))
    settled, carry = F.when(a_first, a), F.when(a_first, b)
    settled, carry = settled.otherwise(b), carry.otherwise(a)
    return F.when(a.isNull(), F.struct(state["done"].alias("done"), b.alias("carry"))).otherwise(
        F.struct(F.concat(state["done"], F.array(settled.withField("p", done_value))).alias("done"), carry.withField("p", left).alias("carry"))
    )


def pivotal_round(rows: DataFrame, most: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Rounds ``p`` in rows ``(group, id, size, p, n)`` to 0 or 1, ``n`` being the rows of the group.

    ``id`` names the row, in any type that orders, and should be distinct: equal ones share a block.
    A reduction tree: rows are dealt by hash into blocks of about ``block`` rows, a group of any size into as
    many as it needs; each block settles all its rows but one, and those residuals are the next level's rows.
    ``most`` is the largest ``n``: it gives the depth, the logarithm of it to the base ``block``. The last
    residual of a group is rounded by itself, so its words differ from the target by one row at most.
    """
    kind = rows.schema["id"].dataType.simpleString()
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("o"), "id", "size", "p", _uniform("id", F.lit(seed + 1)).alias("u"))
    duel = f"struct<o:bigint,id:{kind},size:bigint,p:double,u:double>"
    empty, none = F.array().cast(f"array<{duel}>"), F.lit(None).cast(duel)
    done, level = [], 0
    while True:
        width = block ** (level + 1)
        blocks = F.when(F.col("n") > width, F.ceil(F.col("n") / width)).otherwise(1)
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed + 2 + level)), blocks))
        folded = dealt.groupBy("group", "n", "block").agg(
            F.aggregate(F.array_sort(F.collect_list(order)), F.struct(empty.alias("done"), none.alias("carry")), _pivot).alias("s")
        )
        folded = materialize(folded, "pivot")
        done.append(folded.select("group", F.inline("s.done")).select("group", "id", "size", "p"))
        rest = folded.select("group", F.col("s.carry.id").alias("id"), F.col("s.carry.size").alias("size"), F.col("s.carry.p").alias("p"), "n")
        level += 1
        if width >= most:
            break
        rows = rest
    last = F.when(_uniform("id", F.lit(seed + 1), F.lit(level)) < F.col("p"), 1.0).otherwise(0.0)
    out = rest.select("group", "id", "size", last.alias("p"))
    for d in done:
        out = out.unionByName(d)
    return out


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 0,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)``, a row for each row of ``docs``.

    Each document of a source is wanted ``target / source_size`` times, at most ``cap``: the whole part for
    certain, the fraction by pivotal rounding over the source. Draws come from hashes of id, source and text, so
    reruns agree. Null texts have size 0, as empty ones; rows of size 0 are never taken. A null source is a source
    of its own, the last one. Ids may be of any type that orders, equal and null. Rows repeated with id, source and
    text are one row of the rounding: what they are wanted together is dealt to them in whole copies, and only the
    fraction left is drawn for, so that any number of them costs no more than one. Other columns are not read.
    An empty table gives no rows.
    """
    m = _mixed(docs, id_col, text_col, source_col, weights, share, cap, seed)
    # the copies of a row are numbered in two steps: no array is longer than COPIES
    m = m.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))).alias("part"))
    m = m.select("*", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("m"), (F.col("part") + 1) * COPIES) - 1)).alias("i"))
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("i") < F.col("total") % F.col("m")).cast("long")
    return m.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, cap: int, seed: int) -> DataFrame:
    """``(k1, k2, id, source, size, m, source_size, target, total)``: a row for the ``m`` rows that are equal in id, source and text."""
    sizes = docs.select(*row_keys(id_col, source_col, text_col), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(sizes.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("m")), "sizes")
    targets = materialize(source_targets(sizes, weights, share, cap), "targets")
    most, n_sources = targets.agg(F.max("n"), F.count("*")).first()
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    s = sizes.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = s.select("k1", "k2", "id", "d.source", "size", "m", "source_size", "target", "n", (ratio * F.col("m")).alias("wanted"))
    s = s.withColumn("whole", F.floor("wanted")).withColumn("p", F.col("wanted") - F.col("whole"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    out = s.where(~open_).select("k1", "k2", "id", "source", "size", "m", "source_size", "target", F.col("whole").alias("total"))
    if most:
        row, group = F.struct("k1", "k2", "id", "m", "whole"), F.struct("source", "source_size", "target")
        rounded = pivotal_round(s.where(open_).select(group.alias("group"), row.alias("id"), "size", "p", "n"), most, seed)
        out = out.unionByName(rounded.select("id.k1", "id.k2", "id.id", "group.source", "size", "id.m", "group.source_size", "group.target", (F.col("id.whole") + F.col("p").cast("long")).alias("total")))
    return out


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 0,
) -> DataFrame:
    """The documents of the mix: the rows of ``docs`` that ``mix_sources`` takes, with a column ``copies`` more.

    Documents without words are out, as they give the mix nothing. Of rows repeated with id, source and text one
    stays, with the copies of all; so ``size * copies`` sums to the words taken. A column ``copies`` of ``docs`` goes.
    """
    taken = _mixed(docs, id_col, text_col, source_col, weights, share, cap, seed).where((F.col("total") > 0) & (F.col("size") > 0))
    taken = materialize(taken.select("k1", "k2", F.col("total").alias("copies"), (F.col("m") > 1).alias("again")), "taken")
    n, again = taken.agg(F.count("*"), F.max("again")).first()
    docs = docs.drop("copies")
    k1, k2, twice = fresh(docs, "k1", "k2", "again")
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(id_col, source_col, text_col), strict=True)))
    side = taken.toDF(k1, k2, "copies", twice)
    out = keyed.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, [k1, k2])
    if again:
        out = out.where(~F.col(twice)).unionByName(out.where(twice).dropDuplicates([k1, k2]))
    return out.select(*docs.columns, "copies")
