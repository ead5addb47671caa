"""Summaries, trimming, Z-order and the streaming form."""

import statistics

import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import stats, zorder
from lemmaflow.streaming.trim import fold, trimmed_summaries

VA, VB = [3, 7, 2, 4, 5, 7, 8], [1, 6, 9, 5, 3, 11, 24]
C = [175] + [133] * 32


def frame(spark, **samples):
    return spark.createDataFrame([(k, i, float(x)) for k, v in samples.items() for i, x in enumerate(v)], "k string, i int, x double")


def test_summaries(spark):
    got = {r.k: r for r in stats.summarize(frame(spark, a=VA, b=VB, c=C), ["k"], "x").collect()}
    for k, v, sos in (("a", VA, 30.857143), ("b", VB, 351.714286), ("c", C, 1710.545455)):
        r = got[k]
        assert (r["max"], r["min"], r["sum"], r["count"]) == (max(v), min(v), sum(v), len(v))
        assert r.mean == pytest.approx(statistics.mean(v)) and r.sos == pytest.approx(sos, abs=1e-6)


def test_merge_is_the_whole(spark):
    parts = stats.summarize(frame(spark, a=VA, b=VB), ["k"], "x")
    r = stats.merge_rows(parts, []).first()
    assert (r["max"], r["min"], r["sum"], r["count"]) == (24, 1, 95, 14) and r.sos == pytest.approx(420.357143, abs=1e-6)
    arrays = spark.createDataFrame([([float(x) for x in VA], [float(x) for x in VB], [])], "a array<double>, b array<double>, e array<double>")
    a, b, e = (stats.of_array(F.col(c)) for c in "abe")
    m = arrays.select(stats.merge(a, b).alias("m"), stats.merge(e, a).alias("l"), stats.merge(a, e).alias("r"), a.alias("a"), stats.merge(e, e).alias("n"), stats.variance(stats.merge(a, b)).alias("v")).first()
    assert m.m.sos == pytest.approx(420.357143, abs=1e-6) and m.v == pytest.approx(32.335165, abs=1e-6)
    assert m.l == m.r == m.a and m.n is None


def test_one_value_and_none(spark):
    r = stats.summarize(frame(spark, a=[4]), ["k"], "x").select(stats.variance(stats.struct_of()).alias("v"), stats.std_dev(stats.struct_of()).alias("s"), "sos").first()
    assert tuple(r) == (0, 0, 0)
    assert stats.summarize(frame(spark, a=[]).unionByName(spark.createDataFrame([("n", 0, None)], "k string, i int, x double")), ["k"], "x").count() == 0


def test_trimming_feeds_back(spark):
    r = stats.online_trim_rows(frame(spark, a=[1, 2, 3, 900, 2]), ["k"], ["i"], "x", 3).first()
    assert (r["count"], r.mean, r.sos) == (5, 2, 2)
    state = None
    for x in [1.0, 2.0, 3.0, 900.0, 2.0]:
        state = fold(state, x, 3)
    assert state[3:] == (5, 2.0, 2.0)
    s = stats.one(F.lit(2.0))
    assert spark.range(1).select(stats.is_extreme(2, s, F.lit(9.0)), stats.trim(1, s, F.lit(9.0))).first() == (False, 2.0)


def test_expand_and_json(spark):
    s = stats.summarize(frame(spark, a=VA), ["k"], "x")
    pairs = {r.stat: r.value for r in stats.expand(s, ["k"]).collect()}
    assert set(pairs) == {"max", "min", "mean", "count", "sum", "stdDev", "var"} and pairs["stdDev"] == pytest.approx(2.267787, abs=1e-6)
    j = s.select(stats.to_json(stats.struct_of()).alias("j"), stats.struct_of().alias("s"))
    r = j.select("s", stats.from_json(F.col("j")).alias("back"), stats.from_json(F.lit("[1]")).alias("bad")).first()
    assert r.back == r.s and r.bad is None


def test_zorder(spark):
    df = spark.createDataFrame([(5, 3)], "a int, b int")
    one = df.select(zorder.zkey([zorder.Key("b", 3), zorder.Key("a", 3)]).alias("z")).first().z
    assert one == 0b011011  # bits of b and a in turn: 0 1, 1 0, 1 1
    with_c = [x for x in zorder.schedule([zorder.Key("a", 4), zorder.Key("c", 9, 2, 3), zorder.Key("b", 4)]) if x[0] != 1]
    assert [(0 if n == 0 else 1, bit) for n, bit in with_c] == zorder.schedule([zorder.Key("a", 4), zorder.Key("b", 4)])
    with pytest.raises(ValueError):
        zorder.zkey([zorder.Key("a", 64)])
    wide = spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"))
    assert zorder.cluster(wide, [zorder.Key("a", 4), zorder.Key("b", 4)], 4).count() == 100


def test_rows_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert tuple(zorder.map_columns(df, lambda c: c * 2).first()) == (2, 4, 6)
    assert tuple(zorder.traverse_columns(df, lambda n, c: c + 1).first()) == (2, 3, 4) and zorder.traverse_columns(df, lambda n, c: None) is None
    assert df.select(zorder.fold_columns(df, lambda c, acc: c - acc, F.lit(0))).first()[0] == 1 - (2 - (3 - 0))
    assert [r.id for r in zorder.top_k(spark.range(50), ["id"], 3).collect()] == [0, 1, 2]


def test_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{i}", float(x)) for i, x in enumerate([1, 2, 3, 900, 2])]
    spark.createDataFrame(rows, "k string, ts string, x double").select("k", F.col("ts").cast("timestamp").alias("ts"), "x").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, x double").parquet(str(tmp_path / "in"))
    q = trimmed_summaries(stream, "k", "ts", "x").writeStream.format("memory").queryName("trimmed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.sql("select * from trimmed").first()
    assert (r["count"], r.mean, r.sos) == (5, 2, 2)


def test_following_across_pieces(spark):
    from lemmaflow.operators.ordered import following

    rows = [(t, t * 10) for t in (1, 2, 5, 11, 12, 30, 31, 55)]
    df = spark.createDataFrame(rows, "t int, v int")
    got = {r.t: (r.nt, r.nv) for r in following(df, ["t"], {"nt": "t", "nv": "v"}, F.floor(F.col("t") / 10)).collect()}
    assert got == {a[0]: b for a, b in zip(rows, [*rows[1:], (None, None)], strict=True)}


def test_clustered_files_prune_on_each_key(spark, tmp_path):
    """A value of either key lies in few of the files, by their min/max statistics; sorted by one key, only that one prunes."""
    import pyarrow.parquet as pq

    def files(df, name: str) -> dict[str, int]:
        df.write.parquet(f"file://{tmp_path}/{name}")
        ranges = []
        for p in (tmp_path / name).glob("*.parquet"):
            group = pq.ParquetFile(p).metadata.row_group(0)
            ranges.append({group.column(k).path_in_schema: group.column(k).statistics for k in range(2)})
        return {c: max(sum(s[c].min <= v <= s[c].max for s in ranges) for v in range(64)) for c in ("a", "b")}

    df = spark.range(4096).selectExpr("id % 64 as a", "id div 64 as b")
    both = files(zorder.cluster(df, [zorder.Key("a", 6), zorder.Key("b", 6)], 16), "both")
    one = files(df.repartitionByRange(16, "a"), "one")
    assert max(both.values()) <= 8 and one["b"] >= 15
