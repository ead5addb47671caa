"""Rank and select on sequences in long form, ``(seq_id, pos, sym)`` with positions 0, 1, 2, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a block: prefix counts run within blocks and over blocks, so one long sequence is many tasks.
BLOCK = 1 << 16
#: Positions of a piece, of which a rank query gets the places, and pieces of a stretch, over which their counts are summed.
PIECE, STRETCH = 2048, 512


def prefix_counts(seq: DataFrame) -> DataFrame:
    """``(seq_id, pos, sym, before)``: occurrences of each row's symbol in [0, pos)."""
    s = seq.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    blocks = s.groupBy("seq_id", "sym", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("seq_id", "sym").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("seq_id", "sym", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("blocks_before"))
    within = Window.partitionBy("seq_id", "sym", "block").orderBy("pos")
    s = s.withColumn("inside", F.row_number().over(within) - 1).join(blocks, ["seq_id", "sym", "block"])
    return s.select("seq_id", "pos", "sym", (F.col("blocks_before") + F.col("inside")).alias("before"))


def rank_rows(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """``(seq_id, sym, i, rank)`` for queries ``(seq_id, sym, i)``: occurrences in [0, i), extended past both ends.

    A directory in two levels: occurrences of a symbol by pieces of 2048 positions, and by stretches of 512 pieces. A
    query is put in the order of the pieces of its stretch, and of the stretches, where running sums give what lies
    before it; the piece it is in is found by equality. So a query meets one piece, and the rows of one window are
    the pieces of a stretch and the queries there.
    """
    key, none = ["seq_id", "sym"], F.lit(0).cast("long")
    sizes = seq.groupBy("seq_id").agg(F.count("*").alias("n"))
    q = queries.join(sizes, "seq_id", "left").withColumn("n", F.coalesce("n", none))
    q = q.withColumn("at", F.greatest(F.least("i", "n"), F.lit(0)).cast("long")).withColumn("piece", F.floor(F.col("at") / PIECE))
    pieces = seq.withColumn("piece", F.floor(F.col("pos") / PIECE)).groupBy(*key, "piece").agg(F.count("*").alias("ones"), F.sort_array(F.collect_list("pos")).alias("places"))

    def before(counts: DataFrame, asked: DataFrame, place: str, part: list) -> DataFrame:
        """``asked`` with the sum of ``ones`` at smaller places of the part, by one running sum over both."""
        run = Window.partitionBy(*part).orderBy(place, F.col("ones").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        both = counts.unionByName(asked.withColumn("ones", F.lit(None).cast("long")))
        return both.withColumn("sum", F.coalesce(F.sum("ones").over(run), none)).where("ones is null").select(*asked.columns, "sum")

    stretch = F.floor(F.col("piece") / STRETCH).alias("stretch")
    counts, asked = pieces.select(*key, stretch, "piece", "ones"), q.select(*key, stretch, "piece").distinct()
    near = before(counts, asked, "piece", [*key, "stretch"]).withColumnRenamed("sum", "in_stretch")
    far = before(counts.groupBy(*key, "stretch").agg(F.sum("ones").alias("ones")), asked.select(*key, "stretch").distinct(), "stretch", key).withColumnRenamed("sum", "in_stretches")
    here = q.join(near.join(far, [*key, "stretch"]), [*key, "piece"], "left").join(pieces.drop("ones"), [*key, "piece"], "left")
    hits = F.coalesce("in_stretches", none) + F.coalesce("in_stretch", none) + F.coalesce(F.size(F.filter("places", lambda p: p < F.col("at"))), F.lit(0))
    return here.select(*key, "i", F.when(F.col("i") <= 0, F.col("i").cast("long")).otherwise(hits + F.col("i") - F.col("at")).cast("long").alias("rank"))


def delta_rank_rows(seq: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(seq_id, sym, i, j, n)`` for ranges ``(seq_id, sym, i, j)`` within the sequence: occurrences in [i, j)."""
    ends = ranges.select("seq_id", "sym", F.explode(F.array("i", "j")).alias("i")).distinct()
    r = rank_rows(seq, ends)
    low, high = r.withColumnRenamed("rank", "low"), r.select("seq_id", "sym", F.col("i").alias("j"), F.col("rank").alias("high"))
    return ranges.join(low, ["seq_id", "sym", "i"]).join(high, ["seq_id", "sym", "j"]).select("seq_id", "sym", "i", "j", (F.col("high") - F.col("low")).alias("n"))


def select_rows(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """``(seq_id, sym, k, pos)`` for queries ``(seq_id, sym, k)``: 1-based position of the k-th occurrence, extended past both ends."""
    sizes = seq.groupBy("seq_id").agg(F.count("*").alias("n"))
    totals = seq.groupBy("seq_id", "sym").agg(F.count("*").alias("total"))
    at = prefix_counts(seq).select("seq_id", "sym", (F.col("before") + 1).alias("k"), (F.col("pos") + 1).alias("found"))
    q = queries.withColumn("k", F.col("k").cast("long")).join(sizes, "seq_id", "left").join(totals, ["seq_id", "sym"], "left").join(at, ["seq_id", "sym", "k"], "left")
    n, total = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("total", F.lit(0).cast("long"))
    return q.select("seq_id", "sym", "k", F.when(F.col("k") <= 0, F.col("k")).when(F.col("k") > total, n + F.col("k") - total).otherwise(F.col("found")).cast("long").alias("pos"))
