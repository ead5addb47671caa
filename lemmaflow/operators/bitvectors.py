"""Bit vectors too long for one row: words in rows, with a rank directory.

Long form: ``(bv_id, word_idx, word)``, 64 bits a word, absent words zero; lengths are in ``(bv_id, n_bits)``.
The directory has a row for each chunk of 32 words (2048 bits) with the ones before it and the words themselves, so
that a rank or select query is one join on the chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.words import low_mask, select_word

#: Words of a chunk, and chunks of a block; prefix sums run within blocks and over blocks, never over all chunks at once.
CHUNK_WORDS, BLOCK_CHUNKS = 32, 4096
CHUNK_BITS = 64 * CHUNK_WORDS


def pack_rows(rows: DataFrame, pos: str = "pos", bit: str = "bit", bv_id: str = "bv_id") -> DataFrame:
    """``(bv_id, word_idx, word)`` of one row a bit. Map-side ``bit_or`` leaves one row a word to shuffle. Null bits are zeros."""
    one = F.when(F.col(bit), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(pos), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return rows.groupBy(F.col(bv_id).alias("bv_id"), F.floor(F.col(pos) / 64).cast("long").alias("word_idx")).agg(F.bit_or(one).alias("word"))


def unpack_rows(words: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(bv_id, pos, bit)`` of the words, without what lies beyond the length."""
    each = words.select("bv_id", "word_idx", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftrightunsigned", F.col("word"), j).bitwiseAND(F.lit(1).cast("long")) == 1)).alias("j", "bit"))
    each = each.select("bv_id", (F.col("word_idx") * 64 + F.col("j")).alias("pos"), "bit")
    return each.join(lengths, "bv_id").where(F.col("pos") < F.col("n_bits")).select("bv_id", "pos", "bit")


def index_rows(words: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """``(bv_id, pos, bit)`` for queries ``(bv_id, pos)``; false out of bounds."""
    q = queries.join(lengths, "bv_id", "left").withColumn("word_idx", F.floor(F.col("pos") / 64).cast("long"))
    q = q.join(words, ["bv_id", "word_idx"], "left")
    bit = F.call_function("shiftrightunsigned", F.col("word"), F.pmod(F.col("pos"), F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return q.select("bv_id", "pos", F.coalesce((F.col("pos") >= 0) & (F.col("pos") < F.col("n_bits")) & bit, F.lit(False)).alias("bit"))


def update_rows(words: DataFrame, lengths: DataFrame, changes: DataFrame) -> DataFrame:
    """The words after changes ``(bv_id, pos, bit, ord)``: of one position the largest ``ord`` wins; out of bounds is ignored."""
    c = changes.join(lengths, "bv_id").where((F.col("pos") >= 0) & (F.col("pos") < F.col("n_bits")))
    c = c.groupBy("bv_id", "pos").agg(F.max_by("bit", "ord").alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("pos"), F.lit(64)).cast("int"))
    zero = F.lit(0).cast("long")
    masks = c.groupBy("bv_id", F.floor(F.col("pos") / 64).cast("long").alias("word_idx")).agg(
        F.bit_or(F.when(F.col("bit"), one).otherwise(zero)).alias("on"), F.bit_or(F.when(F.col("bit"), zero).otherwise(one)).alias("off")
    )
    both = words.join(masks, ["bv_id", "word_idx"], "full")
    word = F.coalesce("word", zero).bitwiseAND(F.bitwise_not(F.coalesce("off", zero))).bitwiseOR(F.coalesce("on", zero))
    return both.select("bv_id", "word_idx", word.alias("word"))


def take_rows(words: DataFrame, lengths: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` bits of every vector: words and lengths. Later words are filtered out in the scan."""
    n = max(n, 0)
    w = words.where(F.col("word_idx") < -(-n // 64)).withColumn("word", F.col("word").bitwiseAND(low_mask(F.lit(n) - F.col("word_idx") * 64)))
    return w, lengths.withColumn("n_bits", F.least("n_bits", F.lit(n).cast("long")))


def equal_rows(a: DataFrame, b: DataFrame, lengths_a: DataFrame, lengths_b: DataFrame) -> DataFrame:
    """``(bv_id, equal)`` for vectors by the same id on both sides: equal lengths and no word that differs."""
    zero = F.lit(0).cast("long")
    differ = a.withColumnRenamed("word", "x").join(b.withColumnRenamed("word", "y"), ["bv_id", "word_idx"], "full")
    differ = differ.groupBy("bv_id").agg(F.bool_or(F.coalesce("x", zero) != F.coalesce("y", zero)).alias("differ"))
    both = lengths_a.withColumnRenamed("n_bits", "n").join(lengths_b.withColumnRenamed("n_bits", "m"), "bv_id").join(differ, "bv_id", "left")
    return both.select("bv_id", ((F.col("n") == F.col("m")) & ~F.coalesce("differ", F.lit(False))).alias("equal"))


def directory(words: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(bv_id, chunk, n_bits, ones_before, ones, words)``, a row for every chunk of a vector, empty ones too.

    Prefix sums in two levels: over the blocks of a vector (one row per 8 million bits) and within each block, so a
    single vector's chunks spread over many tasks.
    """
    n_chunks = F.ceil(F.col("n_bits") / CHUNK_BITS).cast("long")
    frame = lengths.where("n_bits > 0").select("bv_id", "n_bits", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("chunk"))
    per = words.groupBy("bv_id", F.floor(F.col("word_idx") / CHUNK_WORDS).cast("long").alias("chunk")).agg(
        F.sum(F.bit_count("word").cast("long")).alias("ones"), F.collect_list(F.struct(F.pmod("word_idx", F.lit(CHUNK_WORDS)).cast("int").alias("k"), "word")).alias("ws")
    )
    c = frame.join(per, ["bv_id", "chunk"], "left").withColumn("ones", F.coalesce("ones", F.lit(0).cast("long")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1)), lambda k: F.coalesce(F.get(F.filter("ws", lambda w: w["k"] == k), F.lit(0))["word"], F.lit(0).cast("long")))
    c = c.withColumn("block", F.floor(F.col("chunk") / BLOCK_CHUNKS).cast("long"))
    blocks = c.groupBy("bv_id", "block").agg(F.sum("ones").alias("n"))
    before = Window.partitionBy("bv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("bv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("block_before"))
    within = Window.partitionBy("bv_id", "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("inside", F.coalesce(F.sum("ones").over(within), F.lit(0).cast("long"))).join(blocks, ["bv_id", "block"])
    return c.select("bv_id", "chunk", "n_bits", (F.col("block_before") + F.col("inside")).alias("ones_before"), "ones", filled.alias("words"))


def rank_rows(pop: DataFrame, queries: DataFrame, bit: bool = True) -> DataFrame:
    """``(bv_id, pos, rank)`` for queries ``(bv_id, pos)`` over a directory: one join on the chunk, then 32 words."""
    ends = pop.groupBy("bv_id").agg(F.max("n_bits").alias("n"), F.sum("ones").alias("total"))
    q = queries.join(ends, "bv_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    q = q.withColumn("chunk", F.floor(F.col("pos") / CHUNK_BITS).cast("long"))
    q = q.join(pop.select("bv_id", "chunk", "ones_before", "words"), ["bv_id", "chunk"], "left")
    inner = F.pmod(F.col("pos"), F.lit(CHUNK_BITS)).cast("long")
    counts = F.transform("words", lambda w, k: F.bit_count(w.bitwiseAND(low_mask(inner - k.cast("long") * 64))).cast("long"))
    ones = F.col("ones_before") + F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    pos, n, total = F.col("pos").cast("long"), F.col("n"), F.col("total")
    inside = ones if bit else pos - ones
    past = (total if bit else n - total) + pos - n
    return q.select("bv_id", "pos", F.when(pos <= 0, pos).when(pos >= n, past).otherwise(inside).alias("rank"))


def select_rows(pop: DataFrame, queries: DataFrame, bit: bool = True) -> DataFrame:
    """``(bv_id, k, pos)`` for queries ``(bv_id, k)``: the 1-based position of the k-th occurrence.

    A chunk answers the k from its first occurrence to its last, a range. Both sides get the number of the stretch
    of 2048 occurrences that k is in: a chunk touches two stretches at most, so the range join is an equi-join.
    """
    size = F.least(F.lit(CHUNK_BITS).cast("long"), F.col("n_bits") - F.col("chunk") * CHUNK_BITS)
    c = pop.withColumn("have", F.col("ones") if bit else size - F.col("ones"))
    c = c.withColumn("before", F.col("ones_before") if bit else F.col("chunk") * CHUNK_BITS - F.col("ones_before"))
    ends = c.groupBy("bv_id").agg(F.max("n_bits").alias("n"), F.sum("have").alias("total"))
    touched = F.sequence(F.floor(F.col("before") / CHUNK_BITS), F.floor((F.col("before") + F.col("have") - 1) / CHUNK_BITS))
    c = c.where("have > 0").select("bv_id", "chunk", "before", "have", "words", "n_bits", F.explode(touched).alias("stretch"))
    q = queries.join(ends, "bv_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    k = F.col("k").cast("long")
    q = q.withColumn("stretch", F.floor((k - 1) / CHUNK_BITS))
    hit = q.alias("q").join(c.alias("c"), (F.col("q.bv_id") == F.col("c.bv_id")) & (F.col("q.stretch") == F.col("c.stretch")) & (F.col("k") > F.col("before")) & (F.col("k") <= F.col("before") + F.col("have")), "left")
    hit = hit.select("q.bv_id", "k", "n", "total", "chunk", "words", (k - F.col("before")).alias("left"))
    start = F.struct(F.col("left").alias("left"), F.lit(None).cast("long").alias("found"), F.lit(0).cast("long").alias("at"))

    def step(s, w):
        ones = F.bit_count(w if bit else F.bitwise_not(w)).cast("long")
        here = s["found"].isNull() & (s["left"] <= ones)
        return F.struct((s["left"] - ones).alias("left"), F.when(here, s["at"] + select_word(bit, w, s["left"])).otherwise(s["found"]).alias("found"), (s["at"] + 64).alias("at"))

    found = F.col("chunk") * CHUNK_BITS + F.aggregate("words", start, step)["found"]
    return hit.select("bv_id", "k", F.when(k <= 0, k).when(k > F.col("total"), F.col("n") + k - F.col("total")).otherwise(found).alias("pos"))
