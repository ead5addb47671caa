"""Exact substring deduplication by bucket-pointer refinement of suffix buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, materialize, row_keys

#: Bytes of the repeated strings, and of the q-grams that spread the suffixes over buckets.
LENGTH, GRAM = 400, 64
#: Bytes of a text that are hashed at once; positions in them must fit 20 bits.
CHUNK = 1 << 19
#: Distinct contexts (each under 2 * LENGTH bytes) that one task refines as one bucket; larger buckets are split by longer q-grams
#: first. Bytes of contexts refined at once, in whole buckets: at about 60 bytes of arrays a byte it bounds a worker's memory.
CONTEXTS, BLOCK = 500, 256 << 10
#: Places (under 40 bytes each, in all documents) up to which they are broadcast to the texts instead of shuffling texts.
BROADCAST_PLACES = 1_000_000
#: Counted digests (under 120 bytes each) up to which they are broadcast.
BROADCAST_COUNTS = 200_000

_SPAN = "k1 bigint, k2 bigint, start int, end int"


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Sampler:
    """For every window of ``length`` bytes, its q-gram with the smallest hash (the leftmost of equal ones).

    A window's choice depends on its bytes alone, so equal windows meet in the bucket of the same q-gram. Windows
    that choose the same place are a run; a text of n bytes has about 2 n / (length - gram) runs.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = 0x5851F42D4C957F2D | 1
        inverse = pow(base, -1, 1 << 64)
        self.powers = np.full(CHUNK + 1, base, np.uint64)
        self.powers[0] = 1
        self.inverses = np.full(CHUNK + 1, inverse, np.uint64)
        self.inverses[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        np.multiply.accumulate(self.inverses, out=self.inverses)

    def runs(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays (hash, place, first window, last window) of the runs, chunk by chunk."""
        step = CHUNK - self.length + 1
        for at in range(0, max(len(text) - self.length + 1, 0), step):
            data = np.frombuffer(text, np.uint8)[at : at + CHUNK]
            h, place, first, last = self._runs(data)
            yield h, place + at, first + at, last + at

    def _runs(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        n, q, wide = len(data), self.gram, self.length - self.gram + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:n], out=sums[1:])
        h = _mix((sums[q:] - sums[:-q]) * self.inverses[: n - q + 1])
        keyed = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
        windows = n - self.length + 1
        padded = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = keyed
        blocks = padded.reshape(-1, wide)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [windows - 1]))
        return h[place[first]], place[first], first, last


def _scanner(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, digest = Sampler(length, gram), hashlib.blake2b
        for b in batches:
            k1, k2, texts = (b.column(k) for k in range(3))
            k1, k2 = k1.to_numpy(), k2.to_numpy()
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            contexts: list[bytes] = []
            for row, text in enumerate(texts):
                if (text := text.as_py()) is None or len(text) < length:
                    continue
                view = memoryview(text)
                for h, place, first, last in sampler.runs(text):
                    contexts += [digest(view[i : j + length], digest_size=16).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                    for p, v in zip(parts, (np.full(len(h), k1[row]), np.full(len(h), k2[row]), h.view(np.int64), place.astype(np.int32), first.astype(np.int32), last.astype(np.int32)), strict=True):
                        p.append(v)
            if contexts:
                yield pa.record_batch([*(pa.array(np.concatenate(p)) for p in parts), pa.array(contexts, pa.binary())], ["k1", "k2", "h", "place", "first", "last", "c"])

    return scan


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows of ``length`` bytes are found more than once in all contexts.

    Bucket-pointer refinement. All positions are put in buckets by their first 8 bytes; ``pointer`` holds, for
    each position, the last slot of its bucket in the suffix array. A pass sorts the positions of each bucket of
    two or more by the bucket pointers at a later offset and writes the refined pointers back; as the next pass
    reads those, each doubles the bytes that a bucket agrees in. Buckets of one position are final and left out.
    The passes stop at the largest power of two within ``length``; a last one joins two overlapping halves.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = len(data) - 8
    left = np.repeat(np.cumsum(sizes), sizes).astype(np.int32)
    left -= np.arange(n, dtype=np.int32)
    grams = np.zeros(n, np.uint64)
    for k in range(8):
        grams <<= np.uint64(8)
        grams |= data[k : n + k]
    short = left < 8
    grams[short] = np.arange(int(short.sum()), dtype=np.uint64)  # suffixes of under 8 bytes are never asked for
    sa = np.argsort(grams, kind="stable").astype(np.int32)
    pointer = np.empty(n, np.int32)

    def point(slots: np.ndarray, new: np.ndarray) -> None:
        """Writes the pointers of the positions in ``slots``; ``new`` marks where a bucket begins."""
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(slots)) - 1
        pointer[sa[slots]] = slots[np.repeat(last, np.diff(np.append(begin, len(slots))))]

    grams = grams[sa]
    slots = np.arange(n, dtype=np.int32)
    point(slots, np.concatenate(([True], grams[1:] != grams[:-1])) if n else np.zeros(0, bool))
    del grams, short

    def refine(slots: np.ndarray, offset: int, whole: int) -> np.ndarray:
        """One pass over the buckets in ``slots``; returns those that are still shared."""
        p = sa[slots]
        shared = pointer[p]
        alike = np.concatenate(([False], shared[1:] == shared[:-1]))
        several = alike | np.append(alike[1:], False)
        slots, p = slots[several], p[several]
        later = np.where(left[p] >= whole, pointer[np.minimum(p + offset, n - 1)], -1)
        key = pointer[p] * np.int64(n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        sa[slots] = p[order]
        key = key[order]
        if len(slots):
            point(slots, np.concatenate(([True], key[1:] != key[:-1])))
        return slots

    depth = 8
    while 2 * depth <= length:
        slots = refine(slots, depth, 2 * depth)
        depth *= 2
    slots = refine(slots, length - depth, length)
    p = sa[slots]
    p = p[left[p] >= length]
    b = pointer[p]
    alike = np.concatenate(([False], b[1:] == b[:-1])) if len(b) else np.zeros(0, bool)
    found = np.zeros(n, bool)
    found[p[alike | np.append(alike[1:], False)] if len(b) else []] = True
    at = np.concatenate(([0], np.cumsum(sizes)))
    return [found[i : max(i, j - length + 1)] for i, j in zip(at[:-1], at[1:], strict=True)]


def _refiner(length: int):
    """Refines whole buckets, rows ``(bucket, k1, k2, first, text)`` sorted by bucket, about ``BLOCK`` bytes at a time."""

    def spans(rows: list[tuple]) -> pa.RecordBatch | None:
        out: list[tuple] = []
        for (_, k1, k2, first, _), hit in zip(rows, repeated_windows([r[4] for r in rows], length), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            out += [(k1, k2, first + int(i), first + int(j) - 1 + length) for i, j in edges.reshape(-1, 2)]
        if out:
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["k1", "k2", "start", "end"])
        return None

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    if size >= BLOCK and row[0] != rows[-1][0]:
                        if out := spans(rows):
                            yield out
                        rows, size = [], 0
                    rows.append(row)
                    size += len(row[4])
        if rows and (out := spans(rows)):
            yield out

    return refine


def _split(contexts: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Splits buckets of too many contexts for one task into such that can be refined.

    Returns those buckets, ``(bucket, k1, k2, first, text)``, and the spans found on the way. A window is named by
    its offset to the bucket's q-gram, and offsets are halved in cells: all windows of a cell share its core, the
    bytes between its outermost windows, which is a longer q-gram. Rows with one core are a bucket of their own;
    contexts alone in theirs have no repeated window there and leave, and buckets of at most ``most`` are ready.
    Of stretches with the same bytes in a cell all windows are repeated: that is said at once, and one of each goes
    on as a partner of those that share a part of it. A cell of one offset has the whole window as its q-gram, so
    the splitting ends after nine steps. Each step counts digests by key, which needs no bucket in one place.
    """
    cells = contexts.select("*", F.explode(F.array(*map(F.lit, range(0, length, 256)))).alias("lo")).withColumn("hi", F.col("lo") + 255)
    ready = done = None
    while True:
        cells = cells.withColumn("lo_in", F.greatest("lo", F.col("place") - F.col("last"))).withColumn("hi_in", F.least("hi", F.col("place") - F.col("first"))).where("lo_in <= hi_in")

        def stretch(high, low):  # the bytes that all windows from offset `high` to `low` reach or share
            return F.substring("text", F.col("place") - high - F.col("first") + 1, high - low + length)

        cells = cells.withColumn("core", F.unhex(F.sha2(stretch(F.col("lo"), F.col("hi")), 256))).withColumn("whole", F.unhex(F.sha2(stretch(F.col("hi_in"), F.col("lo_in")), 256)))
        cells = materialize(cells, "cells")
        # counts are tables of their own: few are broadcast, and of many a join can split the key that most cells have
        cores = materialize(cells.groupBy("h", "lo", "core").agg(F.count("*").alias("n_core")).where("n_core > 1"), "cores")
        me = F.struct("k1", "k2", "place", "first")
        wholes = cells.groupBy("h", "lo_in", "hi_in", "whole").agg(F.count("*").alias("n_whole"), F.min(me).alias("one")).where("n_whole > 1")
        wholes = materialize(wholes, "wholes")
        met = cells.join(_checked(cores), ["h", "lo", "core"]).join(_checked(wholes), ["h", "lo_in", "hi_in", "whole"], "left")
        met = materialize(met, "met")
        same = met.where("n_whole > 1").select("k1", "k2", (F.col("place") - F.col("hi_in")).alias("start"), (F.col("place") - F.col("lo_in") + length).alias("end"))
        rest = met.where((F.col("n_whole").isNull() | (me == F.col("one"))) & (F.col("lo") < F.col("hi")))
        small = rest.where(F.col("n_core") <= most).select(
            F.xxhash64("h", "lo", "core").alias("bucket"), "k1", "k2", (F.col("place") - F.col("hi_in")).alias("first"), stretch(F.col("hi_in"), F.col("lo_in")).alias("text")
        )
        ready, done = (small, same) if ready is None else (ready.union(small), done.union(same))
        rest = rest.where(F.col("n_core") > most).select(*contexts.columns, "lo", "hi", ((F.col("hi") - F.col("lo") + 1) / 2).cast("int").alias("half"))
        if rest.isEmpty():
            return ready, done
        cells = rest.select(*contexts.columns, F.explode(F.array(F.col("lo"), F.col("lo") + F.col("half"))).alias("lo"), "half").withColumn("hi", F.col("lo") + F.col("half") - 1).drop("half")


def _checked(counts: DataFrame) -> DataFrame:
    return F.broadcast(counts) if counts.count() <= BROADCAST_COUNTS else counts


def _with_texts(texts: DataFrame, side: DataFrame, places: str, how: str) -> DataFrame:
    n = side.agg(F.sum(F.size(places) + 1)).first()[0] or 0
    return texts.join(F.broadcast(side) if n <= BROADCAST_PLACES else side, ["k1", "k2"], how)


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the overlapping and touching spans of each text."""
    for b in batches:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for row in b.column(2):
            start, end = (np.asarray(row.values.field(k)) for k in range(2))
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate(([True], start[1:] > reach[:-1]))
            out.append((start[new], reach[np.append(new[1:], True)]))
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array([x[k] for x in out], pa.list_(pa.int32())) for k in range(2))], ["k1", "k2", "starts", "ends"])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, starts, ends in zip(*(b.column(k) for k in (1, 2, 3)), strict=True):
            text, at, removed, n, kept = text.as_py() or b"", 0, 0, 0, hashlib.sha256()
            for i, j in zip(starts.as_py() or (), ends.as_py() or (), strict=True):
                kept.update(text[at:i])
                at, removed, n = j, removed + j - i, n + 1
            kept.update(text[at:])
            out.append((len(text), removed, n, kept.hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.record_batch([b.column(0), *(pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a null-safe key. Rows equal in id and text share it: they are copies, and get the same result."""
    return docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """``(k1, k2, starts, ends)``: the maximal runs of bytes covered by strings of ``length`` bytes that also start elsewhere.

    Plan: (1) one pass samples a q-gram for every window; a row for each run of windows has the q-gram's hash and
    a digest of the run's bytes, its context (BLAKE2b, 128 bits: equal digests stand for equal bytes). (2) Contexts
    found twice are covered whole: that settles copies of any number without their texts. (3) Different contexts in
    one bucket can share some windows, as at the ends of a passage: one of each is fetched, buckets of more than
    ``contexts`` are split by longer q-grams, and all are refined by bucket pointers, which compares bytes.
    """
    texts = _keyed(docs, id_col, text_col)
    runs = texts.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    runs = materialize(runs.mapInArrow(_scanner(length, gram), "k1 bigint, k2 bigint, h bigint, place int, first int, last int, c binary"), "runs")
    counts = runs.groupBy("h", "c").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("n_contexts"), F.count_if(F.col("n") == 1).alias("single")).where("total > 1")
    known = counts.join(buckets, "h").select("h", "c", "n", "n_contexts", ((F.col("n_contexts") > 1) & (F.col("single") > 0)).alias("mixed"))
    hits = materialize(runs.join(known.where("n > 1 or mixed"), ["h", "c"]), "hits")

    whole = hits.where("n > 1").select("k1", "k2", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    one = F.min(F.struct("k1", "k2", "place", "first", "last")).alias("r")
    distinct = hits.where("mixed").groupBy("h", "c").agg(one, F.max("n_contexts").alias("n_contexts")).select("h", "n_contexts", "r.*")
    wanted = distinct.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "place", "first", "last", "n_contexts")).alias("runs"))
    wanted = materialize(wanted, "wanted")
    # of rows with one key any text will do, and their contexts must come once: the key's texts are equal
    fetched = _with_texts(texts.select("k1", "k2", "text"), wanted, "runs", "inner").select("k1", "k2", "text", F.inline("runs"))
    fetched = fetched.select("h", "k1", "k2", "place", "first", "last", "n_contexts", F.substring("text", F.col("first") + 1, F.col("last") - F.col("first") + length).alias("text"))
    fetched = materialize(fetched, "contexts")
    ready = fetched.where(F.col("n_contexts") <= contexts).select(F.col("h").alias("bucket"), "k1", "k2", "first", "text")
    large = fetched.where(F.col("n_contexts") > contexts).drop("n_contexts")
    if not large.isEmpty():
        small, same = _split(large, length, contexts)
        ready, whole = ready.union(small), whole.union(same)
    spans = whole.union(ready.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refiner(length), _SPAN))
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(_merger, "k1 bigint, k2 bigint, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)``, a row for each row of ``docs``.

    Every byte inside a string of ``length`` bytes that also starts anywhere else goes: elsewhere in the text,
    overlapping or not, or in another one. Strings are judged on the input and never cross documents. Null texts
    are empty; texts under ``length`` bytes lose nothing. Ids may be of any type that orders, and null. Rows repeated
    with id and text are copies of each other. An empty table gives no rows. Other columns are not read.
    """
    spans = materialize(repeated_spans(docs, id_col, text_col, length, gram, contexts), "spans")
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    joined = _with_texts(_keyed(docs, id_col, text_col), spans, "starts", "left").select("id", "text", "starts", "ends")
    out = joined.mapInArrow(_cutter, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


by_value(__name__)
