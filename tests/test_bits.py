"""Words, bit vectors, sequences: worked examples and laws against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import bitmaps, sequences, words
from lemmaflow.operators import bitvectors
from lemmaflow.operators import sequences as long_sequences
from lemmaflow.sources.tables import bit_words


def signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


WORDS = [1, 5, 0x80, 0x0123456789ABCDEF, 1 << 63, (1 << 64) - 1, 0x0022FF6780ACCD7F]


def test_words(spark):
    df = spark.createDataFrame([(signed(w),) for w in WORDS], "x bigint")
    fs = [words.reverse_bits, words.reverse_bytes, words.byte_sum, words.byte_counts, words.nonzero8, words.lsb, words.msb, words.pop_count]
    got = df.select(*(f(F.col("x")) for f in fs)).collect()
    for w, r in zip(WORDS, got, strict=True):
        b = [w >> 8 * i & 255 for i in range(8)]
        want = (
            int(f"{w:064b}"[::-1], 2), sum(v << 8 * (7 - i) for i, v in enumerate(b)), sum(b) % 256, sum(v.bit_count() << 8 * i for i, v in enumerate(b)),
            sum((v > 0) << 8 * i for i, v in enumerate(b)), (w & -w).bit_length() - 1, w.bit_length() - 1, w.bit_count(),
        )
        assert tuple(r) == tuple(map(signed, want)), hex(w)
    x, y = (F.lit(v).cast("bigint") for v in (0x0123456789ABCDEF, 0x0022FF6780ACCD7F))
    assert tuple(spark.range(1).select(words.leq8(x, y), words.uleq8(x, y)).first()) == (0x0000000100010101, 0x0000010100010100)


def test_words_of_nothing(spark):
    df = spark.createDataFrame([(None,), (0,)], "x bigint")
    got = df.select(words.lsb("x"), words.msb("x"), words.select_word64("x", 0), words.pop_count("x")).collect()
    assert tuple(got[0]) == (None,) * 4 and tuple(got[1]) == (None, None, None, 0)


def rank(x, xs, i):
    return i if i <= 0 else sum(v == x for v in xs[:i]) + max(0, i - len(xs))


def select(x, xs, k):
    at = [p + 1 for p, v in enumerate(xs) if v == x]
    return k if k <= 0 else at[k - 1] if k <= len(at) else len(xs) + k - len(at)


def test_word_rank_and_select(spark):
    queries = [(signed(w), i) for w in WORDS for i in (-2, 0, 1, 5, 31, 63, 64, 65, 90)]
    df = spark.createDataFrame(queries, "x bigint, i int")
    got = df.select("x", "i", *(f(b, F.col("x"), F.col("i")) for f in (words.rank_word, words.select_word) for b in (True, False))).collect()
    for r in got:
        bits = [bool((r[0] % (1 << 64)) >> j & 1) for j in range(64)]
        assert tuple(r)[2:] == tuple(f(b, bits, r[1]) for f in (rank, select) for b in (True, False)), r


def test_arrays_by_the_documented_examples(spark):
    xs, one = F.array(*map(F.lit, (1, 0, 1))), F.lit(1)
    got = spark.range(1).select(*(sequences.rank(one, xs, F.lit(i)) for i in (-1, 0, 1, 2, 3, 4)), *(sequences.select(one, xs, F.lit(k)) for k in (0, 1, 2, 3))).first()
    assert tuple(got) == (-1, 0, 1, 1, 2, 3, 0, 1, 3, 4)
    assert spark.range(1).select(sequences.delta_rank(one, xs, F.lit(1), F.lit(3))).first()[0] == 1


SIZES = [0, 1, 63, 64, 65, 128, 200]


def test_bitmap_columns(spark):
    rng = random.Random(1)
    vectors = [[rng.random() < 0.4 for _ in range(n)] for n in SIZES]
    df = spark.createDataFrame([(v,) for v in vectors], "xs array<boolean>").withColumn("bm", bitmaps.pack(F.col("xs")))
    bm = F.col("bm")
    probes = (-1, 0, 1, 2, 40, 64, 65, 130, 300)
    changes = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(b).alias("bit")) for i, b in ((0, True), (0, False), (64, True), (-1, True), (9999, True))))
    got = df.select(
        bitmaps.unpack(bm).alias("back"), F.array(*(bitmaps.index(bm, F.lit(i)) for i in probes)).alias("index"),
        *(F.array(*(f(b, bm, F.lit(i)) for i in probes)).alias(f"{f.__name__}{b}") for f in (bitmaps.rank, bitmaps.select) for b in (True, False)),
        F.array(*(bitmaps.unpack(bitmaps.take(bm, F.lit(i))) for i in (-1, 0, 5, 64, 100))).alias("take"), bitmaps.unpack(bitmaps.update(bm, changes)).alias("update"),
        bitmaps.unpack(bitmaps.deserialize(bitmaps.serialize(bm))).alias("bytes"), bitmaps.unpack(bitmaps.read(bitmaps.show(bm))).alias("text"), bitmaps.to_bytes(bm).alias("raw"),
        bitmaps.unpack(bitmaps.each(bm, lambda b: ~b)).alias("not"), bitmaps.is_null(bm).alias("null"), bitmaps.word(bm, F.lit(1)).alias("word"),
    ).collect()
    for v, r in zip(vectors, got, strict=True):
        n = len(v)
        assert r.back == r.bytes == r.text == v and r["not"] == [not b for b in v] and r["null"] == (n == 0)
        assert r["index"] == [0 <= i < n and v[i] for i in probes]
        for f in (rank, select):
            for b in (True, False):
                assert r[f"{f.__name__}{b}"] == [f(b, v, i) for i in probes]
        assert r.take == [v[: max(i, 0)] for i in (-1, 0, 5, 64, 100)]
        want = list(v)
        for i, b in ((0, False), (64, True)):
            if i < n:
                want[i] = b
        assert r.update == want
        assert bytes(r.raw) == bytes(sum(b << j for j, b in enumerate(v[k : k + 8])) for k in range(0, n, 8))
        assert r.word == signed(sum(b << j for j, b in enumerate(v[64:128])))


def test_bitmap_order(spark):
    vectors = [[], [True], [False], [True] * 64, [True] * 63 + [False], [False] * 64, [True] * 65]
    df = spark.createDataFrame([(a, b) for a in vectors for b in vectors], "a array<boolean>, b array<boolean>")
    a, b = bitmaps.pack(F.col("a")), bitmaps.pack(F.col("b"))
    for r in df.select("a", "b", bitmaps.compare(a, b).alias("c"), bitmaps.equal(a, b).alias("e")).collect():
        x, y = (len(r.a), r.a), (len(r.b), r.b)
        assert r.c == (x > y) - (x < y) and r.e == (x == y), r


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 2047, 2048, 2049, 5000])
def test_long_vectors(spark, n):
    rng = random.Random(n)
    v = [rng.random() < 0.3 for _ in range(n)]
    rows = spark.createDataFrame([("v", i, b) for i, b in enumerate(v)], "bv_id string, pos bigint, bit boolean")
    w, lengths = bitvectors.pack_rows(rows), spark.createDataFrame([("v", n), ("none", 0)], "bv_id string, n_bits bigint")
    pop = bitvectors.directory(w, lengths)
    probes = [-3, 0, 1, 2, 63, 64, 65, 2047, 2048, 2049, n - 1, n, n + 7]
    q = spark.createDataFrame([("v", i) for i in probes], "bv_id string, pos bigint")
    for bit in (True, False):
        assert {r.pos: r["rank"] for r in bitvectors.rank_rows(pop, q, bit).collect()} == {i: rank(bit, v, i) for i in probes}
        assert {r.k: r.pos for r in bitvectors.select_rows(pop, q.withColumnRenamed("pos", "k"), bit).collect()} == {k: select(bit, v, k) for k in probes}
    assert {r.pos: r.bit for r in bitvectors.index_rows(w, lengths, q).collect()} == {i: 0 <= i < n and v[i] for i in probes}
    assert [r.bit for r in bitvectors.unpack_rows(w, lengths).orderBy("pos").collect()] == v


def test_long_sequences(spark):
    rng = random.Random(3)
    seqs = {k: [rng.choice("ab") for _ in range(n)] for k, n in (("x", 40), ("y", 1))}
    s = spark.createDataFrame([(k, i, c) for k, v in seqs.items() for i, c in enumerate(v)], "seq_id string, pos bigint, sym string")
    probes = (-1, 0, 1, 2, 7, 39, 40, 50)
    q = spark.createDataFrame([(k, c, i) for k in seqs for c in "abz" for i in probes], "seq_id string, sym string, i bigint")
    for r in long_sequences.rank_rows(s, q).collect():
        assert r["rank"] == rank(r.sym, seqs[r.seq_id], r.i)
    for r in long_sequences.select_rows(s, q.withColumnRenamed("i", "k")).collect():
        assert r.pos == select(r.sym, seqs[r.seq_id], r.k)


def test_files_as_bits(spark, tmp_path):
    data = bytes(range(1, 20))
    (tmp_path / "f.bin").write_bytes(data)
    got = {r.word_idx: r.word for r in bit_words(spark, str(tmp_path)).collect()}
    assert got == {k: signed(int.from_bytes(data[8 * k : 8 * k + 8], "little")) for k in range(3)}
