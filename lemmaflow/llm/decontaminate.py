"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, let, materialize, row_keys

#: What separates words: every ASCII character but digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a window, and words in the k-grams of which a window keeps the one with the smallest hash.
WINDOW, GRAM = 13, 5
#: Rows up to which fingerprints (12 bytes), windows (about 100 bytes) or document keys (16 bytes) are broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATOR), "")


def minima(w: Column, length: int, gram: int = GRAM) -> Column:
    """For each window of ``length`` words of the array ``w``, the smallest hash of its k-grams.

    Windows of the same words keep the same hash, so every shared window meets at its fingerprint, and
    overlapping windows mostly share theirs.
    """
    k = min(gram, length)
    n = F.size(w)
    grams = F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    if length == k:
        return grams
    wide = length - k + 1
    spots = F.sequence(F.lit(1), F.greatest(n - (length - 1), F.lit(1)))
    return F.when(n >= length, let(grams, lambda g: F.transform(spots, lambda i: F.array_min(F.slice(g, i, F.lit(wide)))))).otherwise(F.array().cast("array<bigint>"))


def _print(n: int):
    return lambda x: F.struct(F.lit(n).alias("len"), x.alias("print"))


def _has_length(n: int):
    return lambda p: p["len"] == n


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """The table with a broadcast hint if it has few rows; a shuffled join with skew handling otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, share: int = 20,
) -> DataFrame:
    """``(id, k1, k2, n_words, n_hit, n_items, items_sha256, contaminated, items)``, a row for each row of ``docs``.

    A document word is hit inside any occurrence of ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. ``contaminated``: hits, and ``share * n_hit >= n_words``. Null and
    empty texts have no words and no hits. Items with a null id or text are left out; equal texts under two
    ids are two items. Rows repeated with their id and text each get their result; ``(k1, k2)`` is a null-safe key of both. Other columns are not read.

    Plan: one pass over the texts keeps, for each window, the smallest k-gram hash (once per document and
    value) and joins it with the items' fingerprints. Only documents that share one are read again; there,
    windows with a shared fingerprint are compared word by word with the items' windows.
    """
    bench = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    bench = bench.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    bench = bench.withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    windows = bench.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("len")))).alias("ws"))
    windows = materialize(windows.select("item", "len", F.array_join("ws", " ").alias("ws")).distinct(), "windows")
    n_windows = windows.count()
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # 1 to window
    prints = None
    for n in lengths:
        p = windows.where(F.col("len") == n).select(F.lit(n).alias("len"), F.explode(minima(F.split("ws", " "), n, gram)).alias("print"))
        prints = p if prints is None else prints.union(p)

    d = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    none = F.struct(F.lit(0).alias("len"), F.lit(None).cast("long").alias("print"))

    def fingerprints(w: Column) -> Column:
        every = F.array(none)
        for n in lengths:
            every = F.concat(every, F.transform(F.array_distinct(minima(w, n, gram)), _print(n)))
        return F.struct(F.size(w).cast("long").alias("n_words"), every.alias("every"))

    seen = d.select("id", "k1", "k2", let(words(F.col("text")), fingerprints).alias("f")).select("id", "k1", "k2", "f.n_words", F.inline("f.every"))
    if prints is not None:
        prints = prints.distinct().withColumn("hit", F.lit(True))
        seen = seen.join(_checked(prints, n_windows), ["len", "print"], "left").where((F.col("len") == 0) | F.col("hit"))
    seen = materialize(seen.select("id", "k1", "k2", "n_words", "len", "print"), "prints")

    out = seen.where("len = 0").select("id", "k1", "k2", "n_words")
    shared = seen.where("len > 0").groupBy("k1", "k2").agg(F.collect_set(F.struct("len", "print")).alias("prints"))
    shared = materialize(shared, "shared")
    if not lengths:
        return _report(out, None, id_col, share)
    again = d.join(_checked(shared, shared.count()), ["k1", "k2"])

    def starts_of(n: int):
        def of(w: Column) -> Column:
            mine = F.transform(F.filter("prints", _has_length(n)), lambda p: p["print"])
            marked = let(mine, lambda m: F.transform(minima(w, n, gram), lambda x, i: F.when(F.array_contains(m, x), i)))
            return F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("ws")))

        return of

    at = let(words(F.col("text")), lambda w: F.concat(*(starts_of(n)(w) for n in lengths)))
    found = again.select("k1", "k2", F.inline(at))
    hits = found.join(_checked(windows, n_windows), ["len", "ws"])
    # a start counts once, whichever items have it; the items of a document likewise
    spans = hits.groupBy("k1", "k2", "pos", "len").agg(F.collect_set("item").alias("items"))
    per_doc = spans.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(x["pos"], s["end"]))).alias("n"), F.greatest(s["end"], x["pos"] + x["len"]).alias("end")),
    )["n"]
    return _report(out, per_doc.select("k1", "k2", covered.cast("long").alias("n_hit"), "items", "spans"), id_col, share)


def _report(out: DataFrame, hits: DataFrame | None, id_col: str, share: int) -> DataFrame:
    if hits is None:
        out = out.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        out = out.join(hits, ["k1", "k2"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "k1", "k2", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, **options) -> DataFrame:
    """``docs`` without the rows in which ``find_contamination`` hits at least ``least`` words.

    One window of an item is enough: a passage that is a small share of a long text is as much of a leak as the same
    passage alone, so the share that ``contaminated`` asks for doesn't count here, and no window of an item is left.
    Nulls, empty texts, repeated rows and empty tables are as there; rows without words stay.
    """
    goes = materialize(find_contamination(docs, items, id_col, text_col, **options).where(F.col("n_hit") >= least).select("k1", "k2").distinct(), "goes")
    k1, k2 = fresh(docs, "k1", "k2")
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(id_col, text_col), strict=True)))
    return keyed.join(_checked(goes.toDF(k1, k2), goes.count()), [k1, k2], "left_anti").select(docs.columns)
