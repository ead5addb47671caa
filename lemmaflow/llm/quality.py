"""Quality rules: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value

# Fixed thresholds, published for MassiveText (Rae et al., 2021, table A1): the largest share of characters in ...
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}  # the most frequent n-gram
DUPLICATE_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}  # n-grams found before
DUPLICATE_LINES = 0.20  # lines equal to an earlier one

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "top_ngram_excess", "dup_ngram_excess"]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (splitmix64)."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window of ``length`` words that begins at one of the starts."""
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def measure(text: bytes) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    data = np.frombuffer(text, np.uint8)
    chars = ~_WHITE[data] & ((data & 0xC0) != 0x80)  # first bytes of code points in words
    word_chars, n_symbols = int(chars.sum()), int(_SYMBOL[data].sum())
    seen: set[bytes] = set()
    n_dup_lines = dup_bytes = line_bytes = 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            line_bytes += len(bare)
            if line in seen:
                n_dup_lines += 1
                dup_bytes += len(bare)
            else:
                seen.add(line)
    words = text.split()
    n = len(words)
    dup_line_share = dup_bytes / line_bytes if line_bytes else 0.0
    if n < 3:
        return n, word_chars, n_symbols, n_dup_lines, 0, dup_line_share, 0.0, 0.0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    ends = np.concatenate(([0], np.cumsum(chars)))
    white = _WHITE[data]
    begins = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    before = np.concatenate((ends[begins], [word_chars]))  # word characters before each word
    lengths = np.diff(before)

    roll = _mixed(ids)
    seeds, prime = roll.copy(), np.uint64(0x100000001B3)
    starts = np.arange(n)
    repeat_words, top_excess, dup_excess = 0, 0.0, 0.0
    for size in range(2, 11):
        # a rolling hash of `size` words from that of one word less; only what was repeated then can be now
        starts = starts[starts + size <= n]
        if size > 2:
            inner = np.zeros(n + 1, bool)
            inner[repeated] = True  # noqa: F821
            starts = repeated[(repeated + size <= n) & inner[np.minimum(repeated + 1, n)]]  # noqa: F821
        if not len(starts):
            break
        roll[starts] = roll[starts] * prime + seeds[starts + size - 1]
        if size == 3:  # exact: the base rule counts these; pairs are numbered first, as a product of three numbers may overflow
            pair = np.unique(ids[starts] * len(number) + ids[starts + 1], return_inverse=True)[1]
            keys = pair * len(number) + ids[starts + 2]
        else:
            keys = roll[starts]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        group = np.cumsum(fresh) - 1
        count = np.bincount(group)
        repeated = np.sort(starts[order[count[group] > 1]])
        if not len(repeated):
            break
        if size == 3:
            repeat_words = int(_covered(n, repeated, 3).sum())
        if size in TOP_NGRAM:
            first = starts[order[fresh]]
            mass = np.where(count > 1, count * (before[first + size] - before[first]), 0)
            top_excess = max(top_excess, float(mass.max()) / word_chars / TOP_NGRAM[size])
        if size in DUPLICATE_NGRAMS:
            later = starts[order[~fresh]]  # a text that says a thing twice says half of it again
            share = float(lengths[_covered(n, later, size)].sum()) / word_chars
            dup_excess = max(dup_excess, share / DUPLICATE_NGRAMS[size])
    return n, word_chars, n_symbols, n_dup_lines, repeat_words, dup_line_share, top_excess, dup_excess


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = zip(*(measure(t or b"") for t in b.column(1).to_pylist()), strict=True) if b.num_rows else [[] for _ in COLUMNS]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 3
        yield pa.record_batch([b.column(0), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], ["id", *COLUMNS])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """``(id, COLUMNS..., base_failed, kept)``, a row for each row of ``docs``.

    Base: ``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of ``#*$%&|<>``;
    ``n_dup_lines``, lines with a word that equal an earlier line; ``n_repeat_words``, words in 3-word windows
    found twice or more. ``base_failed``: fewer than ``min_words`` words or more than ``max_repeat`` per cent
    repeated. Otherwise ``kept`` is the verdict of the repetition coverage: rolling hashes of 2 to 10 words mark
    n-grams found twice or more, and the characters in the most frequent one, in all repeats of earlier ones, and in
    duplicate lines are held against the thresholds above. ``*_excess``: the largest quotient of share and threshold.

    Null and empty texts have no words and fail. Repeated rows stay. Other columns are not read. One pass
    without a shuffle; memory is some 100 bytes for each word of the longest text.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in COLUMNS[:5]) + ", " + ", ".join(f"{c} double" for c in COLUMNS[5:])
    m = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(_measures, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    good = (F.col("dup_line_share") <= DUPLICATE_LINES) & (F.col("top_ngram_excess") <= 1) & (F.col("dup_ngram_excess") <= 1)
    return m.select(F.col("id").alias(id_col), *COLUMNS, failed.alias("base_failed"), (~failed & good).alias("kept"))


by_value(__name__)
