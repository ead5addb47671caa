"""64-bit words in bigint columns: scalar functions that stay inside generated code.

A word is the bit pattern of the bigint. ANSI mode raises on overflow, so nothing here multiplies, and a shift
count is never 64 (Spark takes it modulo 64). Null words give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _byte(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long")) if i else x.bitwiseAND(F.lit(255).cast("long"))


def _bytewise(f) -> Column:
    """The word whose byte i is ``f(i)``, a bigint from 0 to 255."""
    return _or([F.shiftleft(f(i), 8 * i) if i else f(0) for i in range(8)])


def _flag(test: Column) -> Column:
    return F.when(test, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def _signed(n: int) -> Column:
    return F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast("long")


def pop_count(x: Column | str) -> Column:
    return F.bit_count(_col(x)).cast("int")


def reverse_bits(x: Column | str) -> Column:
    """Bit i becomes bit 63 - i: neighbours are swapped, then pairs, and so on up to halves."""
    x = _col(x)
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = _signed(mask)
        x = F.shiftrightunsigned(x, width).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), width))
    return x


def reverse_bytes(x: Column | str) -> Column:
    x = _col(x)
    return _bytewise(lambda i: _byte(x, 7 - i))


def byte_sum(x: Column | str) -> Column:
    """The sum of the eight bytes modulo 256."""
    x = _col(x)
    return reduce(lambda a, b: a + b, [_byte(x, i) for i in range(8)]).bitwiseAND(F.lit(255).cast("long"))


def byte_counts(x: Column | str) -> Column:
    """Each byte becomes its number of one bits; ``byte_sum`` of that is ``pop_count``."""
    x = _col(x)
    return _bytewise(lambda i: F.bit_count(_byte(x, i)).cast("long"))


def leq8(x: Column | str, y: Column | str) -> Column:
    """1 in each byte where x's byte is at most y's, as signed bytes."""
    x, y = _col(x), _col(y)
    flip = F.lit(128).cast("long")  # turns signed order into unsigned
    return _bytewise(lambda i: _flag(_byte(x, i).bitwiseXOR(flip) <= _byte(y, i).bitwiseXOR(flip)))


def uleq8(x: Column | str, y: Column | str) -> Column:
    """1 in each byte where x's byte is at most y's, as unsigned bytes."""
    x, y = _col(x), _col(y)
    return _bytewise(lambda i: _flag(_byte(x, i) <= _byte(y, i)))


def nonzero8(x: Column | str) -> Column:
    """1 in each byte that is not zero."""
    x = _col(x)
    return _bytewise(lambda i: _flag(_byte(x, i) != 0))


def select_word64(x: Column | str, k: Column | int) -> Column:
    """0-based position of the k-th (0-based) one bit; null if there are no more than k.

    Halves the word six times: the ones in the lower half tell on which side the bit is.
    """
    x, k = _col(x), k if isinstance(k, Column) else F.lit(k)
    start = F.struct(x.alias("w"), k.cast("int").alias("k"), F.lit(0).alias("at"))

    def step(s: Column, width: Column) -> Column:
        low = s["w"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1)
        ones = F.bit_count(low).cast("int")
        up = s["k"] >= ones
        return F.struct(
            F.when(up, F.call_function("shiftrightunsigned", s["w"], width)).otherwise(low).alias("w"),
            F.when(up, s["k"] - ones).otherwise(s["k"]).alias("k"),
            F.when(up, s["at"] + width).otherwise(s["at"]).alias("at"),
        )

    found = F.aggregate(F.array(*map(F.lit, (32, 16, 8, 4, 2, 1))), start, step)["at"]
    return F.when((k >= 0) & (k < F.bit_count(x)), found)


def lsb(x: Column | str) -> Column:
    """Position of the lowest one bit; null for 0."""
    x = _col(x)
    least = _signed(1 << 63)
    return F.when(x == least, 63).when(x != 0, F.bit_count(F.bitwise_not(x).bitwiseAND(F.when(x == least, F.lit(0).cast("long")).otherwise(x) - 1)).cast("int"))


def msb(x: Column | str) -> Column:
    """Position of the highest one bit; null for 0."""
    x = _col(x)
    return F.when(x != 0, F.length(F.bin(x)) - 1)


def low_mask(i: Column) -> Column:
    """A word whose lowest ``i`` bits are ones, for 0 <= i <= 64."""
    return F.when(i >= 64, F.lit(-1).cast("long")).when(i <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - i).cast("int")))


def rank_word(bit: bool, x: Column | str, i: Column | int) -> Column:
    """Occurrences of ``bit`` in positions [0, i); beyond both ends every position counts as a match."""
    x, i = _col(x), (i if isinstance(i, Column) else F.lit(i)).cast("long")
    ones = F.bit_count(x.bitwiseAND(low_mask(i))).cast("long")
    inside = F.least(i, F.lit(64).cast("long"))
    return F.when(i <= 0, i).otherwise((ones if bit else inside - ones) + (i - inside))


def select_word(bit: bool, x: Column | str, k: Column | int) -> Column:
    """1-based position of the k-th (1-based) occurrence of ``bit``; k for k <= 0, and past the last as if all matched."""
    x, k = _col(x), (k if isinstance(k, Column) else F.lit(k)).cast("long")
    w = x if bit else F.bitwise_not(x)
    total = F.bit_count(w).cast("long")
    return F.when(k <= 0, k).when(k > total, 64 + k - total).otherwise(select_word64(w, (k - 1).cast("int")).cast("long") + 1)
