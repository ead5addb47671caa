"""The registered corpus queries on a data folder: SQL where there is one, else brute force; and the pipeline."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent.parent.parent))

import brute
import corpus_pipeline
from oracle import SF_DIR, check

from lemmaflow.llm.queries import oracle_sql, queries

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no data folder")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    check(spark, queries()[name], oracle_sql()[name])


def test_xxh64_in_sql():
    import random

    import xxhash
    from oracle import connection

    from lemmaflow.llm.equivalents import xxh64_ctes

    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abc dé ßx") for _ in range(n)) for n in range(130)})
    con = connection()
    con.execute("create table texts(sh varchar)")
    con.executemany("insert into texts values (?)", [(t,) for t in texts])
    got = dict(con.sql(f"WITH {xxh64_ctes('texts')} SELECT sh, h FROM hashed").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_suffix_dedup(spark, docs):
    from test_operators import OP3, removed_by_brute

    got = sorted((tuple(r) for r in queries()["op3_suffix_dedup"](spark, SF_DIR).select(*OP3).collect()), key=repr)
    assert got == removed_by_brute([(i, r.text) for i, r in docs.items()], 400)


def test_secrets(spark, docs):
    got = queries()["op4_secrets"](spark, SF_DIR).collect()
    assert {tuple(r)[:5] for r in got} == {brute.secrets_report(i, r.text) for i, r in docs.items()}


def test_simhash(spark, docs):
    got = queries()["op5_simhash"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute.simhash([(i, r.text) for i, r in docs.items()])


def test_quality(spark, docs):
    for r in queries()["op8_quality"](spark, SF_DIR).collect():
        assert brute.quality(docs[r.doc_id].text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_toxicity_and_mixing(spark, docs):
    scores = queries()["op9_toxicity"](spark, SF_DIR).collect()
    assert {r.doc_id for r in scores} == set(docs) and all(0 <= r.score <= 1 for r in scores)
    mix = queries()["op10_mixing"](spark, SF_DIR).collect()
    assert {r.doc_id for r in mix} == set(docs)
    for s in {r.source for r in mix}:
        mine = [r for r in mix if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)


def test_pipeline(spark, docs, tmp_path):
    """Each stage does to its own input what its operator says, row by row; the runs agree."""
    from test_operators import hit_by_brute

    from lemmaflow.llm import toxicity

    now = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, SF_DIR)
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in now.collect()}
        if name != "mixing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = [(i, r.text) for i, r in before.items()]
        if name == "toxicity":
            scores = toxicity.toxicity(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
            assert set(after) == {r.doc_id for r in scores if not r.predicted}
        elif name == "near_duplicates":
            assert set(after) == {c for _, c in brute.simhash(texts).values()}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in hit_by_brute(texts, benchmark) if not r[2]}
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                assert not brute.secrets_base(r.text) or "[SECRET]" in r.text
                if not brute.secrets_base(before[i].text):
                    assert r == before[i]
        else:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"] and set(after) <= set(before)
            assert all(r.copies in (1, 2) and r.text and tuple(r)[:-1] == tuple(before[i]) for i, r in after.items())
        if name != "mixing" and name != "secrets":
            assert all(r == before[i] for i, r in after.items())
    assert sorted(map(repr, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(repr, now.collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    """Every stage takes null and string ids, null, empty and long texts, repeated rows, clashing names, and an empty table."""
    from pyspark.sql import functions as F
    from test_operators import CLASH, prose

    import random

    rng = random.Random(61)
    base = prose(rng, 80)
    passage = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [(f"d{i}", prose(rng, 60)) for i in range(12)] + [("a", base), ("a", base), ("b", base), (None, base), (None, None), ("n", None), ("e", ""), ("w", " \n "), ("long", prose(rng, 20_000)), ("leak", prose(rng, 3000) + " " + passage), ("s", "token = abcdefgh " + prose(rng, 30))]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"source": F.lit("s"), **{c: F.lit(7) for c in CLASH}, "copies": F.lit("x")})
    labels = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id string, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in docs.collect()]
        if name == "near_duplicates":
            assert ids.count("a") == 1 and "b" not in ids and sum(i in ids for i in ("n", "e", "w")) + ids.count(None) == 1
        if name == "decontamination":
            assert "leak" not in ids and "long" in ids
    assert {r.doc_id: r.text for r in docs.collect()}["s"].startswith("[SECRET] ") and not {"n", "e", "w", None} & set(ids)
    assert {type(r.copies) for r in docs.collect()} == {int}
