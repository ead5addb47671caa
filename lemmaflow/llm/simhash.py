"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, connected_components, fresh, materialize

SEED, SHINGLE = 42, 3
#: Postings of a key up to which its pairs are listed; larger ones are listed by longer keys first, under which 256 meet at most.
POSTINGS = 256
#: Rows of an id and a hash (16 bytes) up to which they are broadcast to the texts.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 (seed 42) of the word shingles; 0 without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t or b"") for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.record_batch([*b.columns[:1], *b.columns[2:], pa.array(prints.view(np.int64))], ["id", "key", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, print)``, the fingerprint as a bigint of the same bits; a row for each row of ``docs``.

    ``key`` is a hash of id and text, so that with the id it names a row even if ids are repeated or null.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"), F.xxhash64(id_col, text_col))
    return rows.mapInArrow(_fingerprints, f"id {kind}, key bigint, print bigint")


def _masked(keep: tuple[int, ...]) -> Column:
    """The fingerprint with only the bytes at the positions ``keep``."""
    mask = sum(0xFF << (8 * k) for k in keep)
    return F.col("print").bitwiseAND(mask - (1 << 64) if mask >> 63 else mask)


def links(prints: DataFrame, bits: int = 2, postings: int = POSTINGS) -> DataFrame:
    """Edges ``(src, dst)`` of the distinct fingerprints ``print`` within ``bits`` (at most 2) differing bits.

    Fingerprints that differ in 2 bits share at least 6 of their 8 positional bytes. The inverted index lists each
    under the 28 choices of 6 positions with the bytes there; a pair that shares m bytes meets under 1 (m = 6) or 7
    (m = 7) of the keys. Those meetings are tallied per pair, which gives the number of shared bytes; pairs that reach
    6 are verified bit by bit. Below 6 a pair has no posting in common and never arises.

    Under a key all that can differ is the two bytes left out. A list of more than ``postings`` is taken apart by
    longer keys before its pairs are listed: within 2 bits a pair also shares one of those two bytes, or half of
    each, so it meets under one of six longer keys, each of 7 bytes, under which 256 fingerprints meet at most. So
    every pair listed shares the guaranteed bytes, and a fingerprint has a bounded number of partners in any data.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees matches up to 2 differing bits")
    choices = list(combinations(range(8), 6))
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), _masked(c).alias("bytes")) for k, c in enumerate(choices)))
    index = materialize(prints.select("print", F.inline(keys)), "index")
    counts = index.groupBy("choice", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(index.join(counts, ["choice", "bytes"]), "met")

    free = F.array(*(F.array(*(F.lit(8 * p) for p in range(8) if p not in c)) for c in choices))
    left = [F.call_function("shiftrightunsigned", F.col("print"), F.get(F.get(free, F.col("choice")), F.lit(j))).bitwiseAND(0xFF) for j in (0, 1)]
    longer = [left[0], left[1]] + [(a.bitwiseAND(15) if low else F.shiftright(a, 4)) * 16 + (b.bitwiseAND(15) if low_b else F.shiftright(b, 4)) for a, b in (left,) for low in (0, 1) for low_b in (0, 1)]
    longer = F.array(*(x.cast("int") + F.lit(256 * k) for k, x in enumerate(longer)))
    lists = met.select("choice", "bytes", "print", F.explode(F.when(F.col("n") > postings, longer).otherwise(F.array(F.lit(-1)))).alias("longer"))
    lists = lists.groupBy("choice", "bytes", "longer").agg(F.sort_array(F.collect_list("print")).alias("m")).where(F.size("m") > 1)
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    meetings = lists.select("choice", F.inline(pairs)).distinct()
    tally = meetings.groupBy("src", "dst").agg(F.count("*").alias("shared_keys"))
    shared = F.when(F.col("shared_keys") == len(choices), 8).when(F.col("shared_keys") >= 7, 7).otherwise(6)
    return tally.where((shared >= 8 - bits) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits)).select("src", "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """``(id, key, print, component_id, first)``, a row for each row of ``docs``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; a component has the smallest id in
    it. Equal fingerprints are one node of the graph, however many documents have it. Null and empty texts have
    fingerprint 0 and are linked like any others. A null id is no component's name unless all its ids are null.
    Rows repeated stay. Other columns are not read. ``first``: the row is the component's first by id, and then
    by ``key``; rows repeated with id and text are first together.
    """
    p = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    one = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    nodes = materialize(p.groupBy("print").agg(F.min(one).alias("one")), "nodes")
    parts = materialize(connected_components(links(nodes.select("print"), bits)), "parts")
    node = nodes.join(parts, nodes["print"] == parts["node"], "left").select("print", "one", F.coalesce("component", "print").alias("component"))
    names = node.groupBy("component").agg(F.min("one").alias("leader"))
    named = node.join(names, "component").select("print", "leader")
    first = (F.col("key") == F.col("leader.key")) & F.col("id").eqNullSafe(F.col("leader.id"))
    return p.join(named, "print").select(F.col("id").alias(id_col), "key", "print", F.col("leader.id").alias("component_id"), first.alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: the first by id, then by a hash of the text."""
    near = materialize(near_duplicates(docs, id_col, text_col, bits), "near")
    row, of_id, of_key = fresh(docs, "row", "of_id", "of_key")
    goes = near.where(~F.col("first")).select(F.col(id_col).alias(of_id), F.col("key").alias(of_key)).distinct()
    same = near.where("first").groupBy(F.col(id_col).alias(of_id), F.col("key").alias(of_key)).agg(F.count("*").alias("n")).where("n > 1").select(of_id, of_key)
    goes, same = materialize(goes, "goes"), materialize(same, "same")

    def side(d: DataFrame) -> DataFrame:
        return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d

    keyed = docs.withColumn(row, F.xxhash64(id_col, text_col))
    of = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(row) == F.col(of_key))
    kept = keyed.join(side(goes), of, "left_anti")
    if not same.isEmpty():  # rows repeated with id and text: any of them
        kept = kept.join(side(same), of, "left_anti").unionByName(kept.join(side(same), of, "left_semi").dropDuplicates([id_col, row]))
    return kept.select(docs.columns)


by_value(__name__)
