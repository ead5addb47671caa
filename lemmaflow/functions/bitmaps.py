"""Bit vectors as columns: ``struct<n_bits: bigint, words: array<bigint>>``, least significant bit first.

Bits of the last word beyond ``n_bits`` are zero in every vector made here. Positions are 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import low_mask, select_word64

TYPE = "struct<n_bits:bigint,words:array<bigint>>"


def let(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_required(n_bits: Column) -> Column:
    return F.ceil(n_bits / 64).cast("int")


def bytes_required(n_bits: Column) -> Column:
    """Bytes of the words that hold so many bits."""
    return words_required(n_bits) * 8


def _upto(n: Column) -> Column:
    """0 to n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _bit(w: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", w, j.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def make(n_bits: Column, words: Column) -> Column:
    """A vector of the first ``n_bits`` bits of ``words``, at most all of them; the tail is cleared."""
    n = F.greatest(F.lit(0).cast("long"), F.least(n_bits.cast("long"), F.size(words).cast("long") * 64))

    def cut(n: Column) -> Column:
        used = F.slice(words, F.lit(1), words_required(n))
        return F.struct(n.alias("n_bits"), F.transform(used, lambda w, i: w.bitwiseAND(low_mask(n - i.cast("long") * 64))).alias("words"))

    return let(n, cut)


def pack(bits: Column) -> Column:
    """The vector of an ``array<boolean>``; null elements are zeros."""

    def word(w: Column) -> Column:
        part = F.slice(bits, w * 64 + 1, F.lit(64))
        ones = F.transform(part, lambda b, j: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(ones, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    n = F.size(bits).cast("long")
    return F.struct(n.alias("n_bits"), F.transform(_upto(words_required(n)), word).alias("words"))


def unpack(bm: Column) -> Column:
    """The vector's bits as ``array<boolean>``."""
    each = F.flatten(F.transform(bm["words"], lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: _bit(w, j))))
    return F.slice(each, F.lit(1), bm["n_bits"].cast("int"))


def size(bm: Column) -> Column:
    return bm["n_bits"]


def is_null(bm: Column) -> Column:
    return bm["n_bits"] == 0


def empty() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n_bits"), F.array().cast("array<bigint>").alias("words"))


def contains(bm: Column, i: Column) -> Column:
    """Whether position i is within the vector."""
    return (i >= 0) & (i < bm["n_bits"])


def index(bm: Column, i: Column) -> Column:
    """Bit i; false out of bounds."""
    w = F.get(bm["words"], F.when(i >= 0, F.floor(i / 64)).otherwise(-1).cast("int"))
    return F.coalesce(contains(bm, i) & _bit(w, F.pmod(i, F.lit(64))), F.lit(False))


def word(bm: Column, i: Column) -> Column:
    """Word i, with the bits beyond the end cleared; 0 out of bounds."""
    w = F.coalesce(F.get(bm["words"], F.when(i >= 0, i).otherwise(-1).cast("int")), F.lit(0).cast("long"))
    return w.bitwiseAND(low_mask(bm["n_bits"] - i.cast("long") * 64))


def take(bm: Column, n: Column) -> Column:
    """The first n bits."""
    return make(F.least(F.greatest(n, F.lit(0)).cast("long"), bm["n_bits"]), bm["words"])


def update(bm: Column, changes: Column) -> Column:
    """Bits set by an ``array<struct<i, bit>>``; later changes win, those out of bounds are ignored."""

    def changed(w: Column, k: Column) -> Column:
        mine = F.filter(changes, lambda c: (c["i"] >= 0) & (c["i"] < bm["n_bits"]) & (F.floor(c["i"] / 64) == k))

        def put(a: Column, c: Column) -> Column:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c["i"], F.lit(64)).cast("int"))
            return F.when(c["bit"], a.bitwiseOR(one)).otherwise(a.bitwiseAND(F.bitwise_not(one)))

        return F.aggregate(mine, w, put)

    return F.struct(bm["n_bits"].alias("n_bits"), F.transform(bm["words"], changed).alias("words"))


def equal(a: Column, b: Column) -> Column:
    return (a["n_bits"] == b["n_bits"]) & (a["words"] == b["words"])


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: shorter before longer, then by the first different bit, false before true."""

    def content(d: Column) -> Column:
        first = F.filter(d, lambda x: x["x"] != x["y"])
        lowest = lambda x: x["x"].bitwiseXOR(x["y"])
        at = select_word64(lowest(F.get(first, F.lit(0))), 0)
        return F.when(F.size(first) == 0, 0).when(_bit(F.get(first, F.lit(0))["x"], at), 1).otherwise(-1)

    pairs = F.zip_with(a["words"], b["words"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(a["n_bits"] < b["n_bits"], -1).when(a["n_bits"] > b["n_bits"], 1).otherwise(let(pairs, content))


def _ones_before(bm: Column, i: Column) -> Column:
    masked = F.transform(bm["words"], lambda w, k: F.bit_count(w.bitwiseAND(low_mask(i - k.cast("long") * 64))).cast("long"))
    return F.aggregate(masked, F.lit(0).cast("long"), lambda s, c: s + c)


def rank(bit: bool, bm: Column, i: Column) -> Column:
    """Occurrences of ``bit`` in [0, i); i for i <= 0; beyond the end every position counts."""
    i = i.cast("long")
    inside = F.least(i, bm["n_bits"])
    ones = _ones_before(bm, inside)
    return F.when(i <= 0, i).otherwise((ones if bit else inside - ones) + (i - inside))


def select(bit: bool, bm: Column, k: Column) -> Column:
    """1-based position of the k-th occurrence of ``bit``; k for k <= 0; n + k - total past the last."""
    k = k.cast("long")
    counted = F.transform(bm["words"], lambda w, j: (w if bit else F.bitwise_not(w)).bitwiseAND(low_mask(bm["n_bits"] - j.cast("long") * 64)))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("found"))

    def step(s: Column, w: Column) -> Column:
        ones = F.bit_count(w).cast("long")
        here = s["found"].isNull() & (s["seen"] + ones >= k)
        return F.struct((s["seen"] + ones).alias("seen"), (s["at"] + 64).alias("at"), F.when(here, s["at"] + select_word64(w, (k - s["seen"] - 1).cast("int")) + 1).otherwise(s["found"]).alias("found"))

    done = F.aggregate(counted, start, step)
    return F.when(k <= 0, k).otherwise(let(done, lambda d: F.coalesce(d["found"], bm["n_bits"] + k - d["seen"])))


def each(bm: Column, f) -> Column:
    """The vector with ``f`` applied to every bit."""
    return pack(F.transform(unpack(bm), f))


def to_bytes(bm: Column) -> Column:
    """The bits as binary: ceil(n_bits / 8) bytes, least significant first."""
    turned = F.transform(bm["words"], lambda w: F.concat(*(F.substring(F.lpad(F.hex(w), 16, "0"), 15 - 2 * k, 2) for k in range(8))))
    return F.substring(F.unhex(F.array_join(turned, "")), F.lit(1), F.ceil(bm["n_bits"] / 8).cast("int"))


def from_bytes(data: Column, n_bits: Column | None = None) -> Column:
    """The vector of binary data: 8 bits a byte, or the first ``n_bits`` of them."""
    n = F.octet_length(data)
    text = F.hex(data)

    def word_at(i: Column) -> Column:
        part = F.rpad(F.substr(text, i * 16 + 1, F.lit(16)), 16, "0")
        return F.conv(F.concat(*(F.substring(part, 15 - 2 * k, 2) for k in range(8))), 16, -10).cast("long")

    words = F.transform(_upto(F.ceil(n / 8).cast("int")), word_at)
    return make(n_bits if n_bits is not None else n.cast("long") * 8, words)


def serialize(bm: Column) -> Column:
    """Binary: the number of bits as 8 bytes, most significant first, then ``to_bytes``."""
    return F.concat(F.unhex(F.lpad(F.hex(bm["n_bits"]), 16, "0")), to_bytes(bm))


def deserialize(data: Column) -> Column:
    n = F.conv(F.hex(F.substring(data, 1, 8)), 16, -10).cast("long")
    return from_bytes(F.substring(data, F.lit(9), F.octet_length(data)), n)


def show(bm: Column) -> Column:
    """Text form, as in ``_Bitmap # [True,False]``."""
    return F.concat(F.lit("_Bitmap # ["), F.array_join(F.transform(unpack(bm), lambda b: F.when(b, "True").otherwise("False")), ","), F.lit("]"))


def read(text: Column) -> Column:
    """The vector of a text form."""
    inner = F.regexp_extract(text, r"\[(.*)\]", 1)
    return pack(F.when(F.trim(inner) == "", F.array().cast("array<boolean>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x) == "True")))
