"""Licence scans by canonical digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, row_keys
from .license_texts import KNOWN

# Spellings that count as one, in canonical words; the second one stays.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("organisations", "organizations"),
    ("noncommercial", "non commercial"), ("sharealike", "share alike"), ("noninfringement", "non infringement"), ("merchantibility", "merchantability"),
    ("v2", "version 2"), ("v3", "version 3"), ("v 2", "version 2"), ("v 3", "version 3"), ("ver 2", "version 2"), ("ver 3", "version 3"), ("https", "http"), ("the software is provided", "software is provided"),
]
#: Words that make of a capitalized "Copyright ..." something else than a holder: part of a licence's own sentence.
_NO_HOLDER = r"(?!(?i:holders?|owners?|notices?|laws?|licen[cs]es?|licen[cs]ed|statements?|acts?|and|or|interests?|claims?|in|of|on|to|protections?|infringements?|status|treaty|treaties|disclaimers?|rights?|is|are|be|shall|may|as|for|that|this|information)\b)"
#: A period inside a sentence: after an initial or a title, or before anything but a new sentence.
_INNER = r"\.(?:(?![\x20\t]+[\p{Lu}\"]|[\x20\t]*(?:\n|$))|(?<=\b\p{Lu}\.|\b(?:Dr|Mr|Ms|Mrs|St|Jr|Prof)\.))"
_SENTENCE = rf"[^\n.]*+(?:{_INNER}[^\n.]*+)*+\.?"
#: A name: capitalized words and what joins them, to the end of the sentence.
_WORD = rf"[^\s,;.]*+(?:{_INNER}[^\s,;.]*+)*+"
_NAME = rf"(?:(?i:the|by)[\x20\t]+)?{_NO_HOLDER}\p{{Lu}}{_WORD}(?:(?:,?[\x20\t]+|,)(?:[\p{{Lu}}&<\d]{_WORD}|(?:and|of|the|for|de|la|van|von|der|et|al|others|contributors|authors|its)\b))*+[\x20\t,]*+(?:\.|(?=\n|$))"
#: The statement of a holder at the start of a line: the word or sign of copyright, then a sign, a year (or a
#: placeholder in brackets) or a name, up to the end of the sentence. What else stands in the line stays.
COPYRIGHT = (
    r"(^|\n)[\x20\t#*/;-]*(?:"
    r"(?:(?i:copyright)[\x20\t:]*)?(?:©|&copy;)" + _SENTENCE + r"|"
    r"(?i:copyright)[\x20\t:]*(?i:\(c\))" + _SENTENCE + r"|"
    r"(?:(?i:copyright)|(?i:\(c\))(?:[\x20\t]*(?i:copyright))?)[\x20\t:,]*(?:(?i:by|the)[\x20\t]+)?(?:(?:19|20)(?:\d\d|yy|xx)\b|[\[<{])" + _SENTENCE + r"|"
    r"(?:[Cc]opyright|COPYRIGHT|\([cC]\)(?:[\x20\t]*(?i:copyright))?)[\x20\t:]+" + _NAME + r")"
)
#: The same inside a line, from the word and a year up to the words that open a licence: of texts that were put on one line.
INSIDE = (
    r"(?i:copyright)[\x20\t:]*(?:\([cC]\)|©)?[\x20\t]*(?:19|20)\d\d[^\n.]{0,200}?[\x20\t]"
    r"(?=(?:Permission\x20(?:is\x20hereby|to\x20use)|Redistribution\x20and\x20use|Licensed\x20under|Released\x20under|This\x20(?:program|software|library)\x20is)\b)"
)
#: Rows of known digests up to which they are broadcast; a row is 64 hex digits and a name.
BROADCAST_ROWS = 100_000


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, as an array without empty ones.

    Statements of copyright holders go, A-Z is lower-cased, ``&`` is ``and``, everything but letters, digits and non-ASCII
    characters is one space, and equivalent spellings become one, word by word: each word has spaces of its own
    while they are replaced, so that neighbours don't share one.
    """
    bare = F.regexp_replace(F.regexp_replace(text, INSIDE, ""), COPYRIGHT, "$1")
    low = F.replace(ascii_lower(bare), F.lit("&"), F.lit(" and "))
    flat = F.concat(F.lit(" "), F.regexp_replace(low, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", "  "), F.lit(" "))
    flat = F.replace(flat, F.lit("\n"), F.lit(" \n "))
    for old, new in SPELLINGS:
        flat = F.replace(flat, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return F.array_remove(lines, "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(digest, license)`` of licence texts, whole and joined over their lines; of twins the first name by order."""
    t = spark.createDataFrame(known, "license string, text string")
    t = t.select("license", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"))
    return t.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_digest, text_license, n_license_lines, licenses)``, a row for each row of ``docs``.

    ``text_license`` is the licence that the entire text is, by its canonical digest, else null. Licence notices
    also stand in other texts: the entire canonical text of every line is looked up too, and ``n_license_lines``
    counts the distinct lines that are a licence, ``licenses`` has their and the text's names, sorted and
    comma-joined. Null and empty texts have the digest of the empty text and no licence. Ids may be of any type, equal
    and null. Rows repeated each get their result. An empty table gives no rows. Other columns are not read. Two known
    texts of one digest are one.

    Plan: one pass over the texts; digests of lines are joined with the known ones where they arise, and only
    hits go on. The known digests are broadcast after a count; a larger table is joined by a shuffle.
    """
    n_known = known.count()
    names = known.withColumnRenamed("license", "found")
    names = F.broadcast(names) if n_known <= BROADCAST_ROWS else names
    d = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole, line = F.lit(True).alias("whole"), F.lit(False).alias("whole")
    units = let(
        canonical_lines(F.col("text")),
        lambda c: F.concat(F.array(F.struct(whole, digest(F.array_join(c, " ")).alias("digest"))), F.transform(F.array_distinct(c), lambda x: F.struct(line, digest(x).alias("digest")))),
    )
    seen = d.select("id", "k1", "k2", F.inline(units)).join(names, "digest", "left").where("whole or found is not null")
    seen = materialize(seen, "licenses")
    lines = seen.where("not whole").select("k1", "k2", "digest", "found").distinct()
    lines = lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.collect_set("found").alias("names"))
    out = seen.where("whole").join(lines, ["k1", "k2"], "left")
    all_names = F.array_sort(F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("found").isNotNull(), F.array("found")).otherwise(F.array().cast("array<string>")))))
    return out.select(
        F.col("id").alias(id_col), F.col("digest").alias("text_digest"), F.col("found").alias("text_license"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.array_join(all_names, ",").alias("licenses")
    )
