"""Secret scans: known shapes, and a randomness test battery for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, let, materialize, row_keys, running

# Fixed values of the base scan: kind, pattern, group whose length counts, least length of it.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of fewer fails, so only longer ones are looked for
]
KINDS = [k for k, *_ in BASE] + ["random"]
#: Alphabets of the inferred encodings, smallest first; a token belongs to the first that has all its symbols.
#: Hyphens between groups do not count, except in base64, where they are a symbol.
ENCODINGS = [
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$"),
    ("base32low", "abcdefghijklmnopqrstuvwxyz234567", r"^[a-z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[0-9A-Z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/_-]+$"),
]
#: Shares in percent of the letters in European prose, and its common pairs of letters; any case counts.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", [12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.1, 0.07]))
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea "
    "ra ce li ch ll be ma si om ur ei ie sc un ge el la qu ue os ad do sh ec ai us et tr ta il ss ol id pr am em di ac ul"
).split()
#: How symbols follow one another in words, names of code, paths and dates: shares of the next symbol's kind by the one before it.
#: Kinds: small letter, capital, digit, sign. The first symbol follows a sign.
FOLLOWS = [(0.85, 0.07, 0.04, 0.04), (0.60, 0.30, 0.05, 0.05), (0.15, 0.15, 0.60, 0.10), (0.50, 0.25, 0.20, 0.05)]
#: Least information of a token in bits, false-discovery rate, and steps of the grid of p-values a decade.
MIN_BITS, RATE, STEPS = 80.0, 0.01, 8
#: Rows of spans (under 200 bytes each) up to which they are broadcast to the texts.
BROADCAST_ROWS = 100_000

#: Pieces of a text that are cut out of one stretch of it: a place in a long text is counted from its start.
PIECES = 256

_SPAN = "array<struct<start:int,rank:int,end:int>>"
_FOUND = "array<struct<start:int,rank:int,end:int,token:string>>"


def _places(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of all matches, in code points, of which ``keep(match)`` holds; without ``keep`` of all, with their ``token``.

    A text is its matches and what lies between them, so running sums of the lengths of both give the places.
    """
    empty = F.array().cast(_SPAN if keep else _FOUND)

    def spans(matches: Column) -> Column:
        def placed(x: Column) -> Column:
            at = running(F.transform(x["gaps"], lambda g, i: g + F.coalesce(F.get(x["lengths"], i), F.lit(0))), F.lit(0), lambda s, v: s + v)
            return let(F.struct(at.alias("at"), x["gaps"].alias("gaps"), x["lengths"].alias("lengths"), x["of"].alias("of")), lambda y: _spans_of(y, rank, keep is None))

        of = F.transform(matches, keep) if keep else matches
        parts = F.struct(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps"), F.transform(matches, lambda m: F.length(m)).alias("lengths"), of.alias("of"))
        return F.when(F.size(matches) > 0, let(parts, placed)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _spans_of(y: Column, rank: int, tokens: bool) -> Column:
    def span(n: Column, i: Column) -> Column:
        start, of = F.get(y["at"], i) + F.get(y["gaps"], i), F.get(y["of"], i)
        found = [start.alias("start"), F.lit(rank).alias("rank"), (start + n).alias("end")]
        return F.struct(*found, of.alias("token")) if tokens else F.when(of, F.struct(*found))

    return F.filter(F.transform(y["lengths"], span), lambda x: x.isNotNull())


def _outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``, which is sorted: by bisection for the last that starts before the end."""

    def look(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(base).cast("double") + 1)).cast("int"))

        def before(m: Column) -> Column:  # number of base spans that start before the end of m
            def step(s: Column, _: Column) -> Column:
                mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
                right = F.get(base, mid)["start"] < m["end"]
                go = s["lo"] < s["hi"]
                return F.struct(F.when(go & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~right, mid).otherwise(s["hi"]).alias("hi"))

            return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi")), step)["lo"]

        # reach of all base spans before the i-th; its last value is the reach of all
        return F.filter(spans, lambda m: F.get(x, before(m)) <= m["start"])

    reach = running(F.concat(F.transform(base, lambda b: b["end"]), F.array(F.lit(0))), F.lit(0), lambda s, v: F.greatest(s, v))
    return F.when((F.size(base) > 0) & (F.size(spans) > 0), let(reach, look)).otherwise(spans)


def _base_spans(text: Column, rank: int) -> Column:
    _, pattern, group, least = BASE[rank]
    if not group:
        return _places(text, pattern, rank, lambda m: F.length(m) >= least)
    return _places(text, pattern, rank, lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least)


def _normal_tail(z: Column) -> Column:
    """P(N > z) by Abramowitz and Stegun 26.2.17, within 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = let(t, lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return let(upper, lambda u: F.greatest(F.when(z >= 0, u).otherwise(1 - u), F.lit(1e-40)))


def facts(letters: str) -> dict:
    """What the battery needs of an encoding: shares and scores of its symbols in prose, and how words would spell them."""
    k = len(letters)
    times = {x: letters.lower().count(x) for x in LETTERS}
    scores = {x: math.log(LETTERS[x.lower()] / 100 + 0.002) for x in letters if x.isalpha()}
    mean = sum(scores.values()) / len(scores)
    kinds = [0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 for x in letters]
    of_kind = [math.log(LETTERS[x.lower()] / 100) if x.isalpha() else math.log(1 / 10 if x.isdigit() else 1 / 2) for x in letters]
    return {
        "k": float(k), "pair": sum(times[a] * times[b] for a, b in PAIRS) / k**2, "scores": [scores.get(x, mean) - mean for x in letters],
        "sd": math.sqrt(sum((x - mean) ** 2 for x in scores.values()) / len(scores)), "share": len(scores) / k,
        "cases": any(map(str.islower, letters)) and any(map(str.isupper, letters)), "kinds": kinds, "words": of_kind,
    }


def _constants(name: str, letters: str) -> Column:
    fixed = [F.array(*map(F.lit, v)).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in facts(letters).items()]
    return F.struct(F.lit(name).alias("name"), F.lit(letters).alias("letters"), *fixed)


def battery(tokens: DataFrame, col: str = "token") -> DataFrame:
    """Adds ``encoding``, ``bits``, ``p`` and ``p_word``: how likely a uniform random string looks as odd as the token, and a word as random.

    Three tests on the symbols' numbers in the alphabet: chi-squared of the counts against a uniform alphabet
    (Wilson and Hilferty's cube root), Wald and Wolfowitz's runs below and above the middle of the alphabet, and
    the correlation of neighbours. Three more tell words: the number of small letters among all letters (of
    letters among all symbols, where the alphabet has one case), the mean log share that the letters have in
    prose, and the common pairs of letters (square root of the count). All have the uniform alphabet as null
    hypothesis. Fisher's sum joins them; as some look at the same counts, its variance is about 36 (simulated)
    and not 24, so it counts as four independent tests (Brown, 1975). Null tokens have null results.

    ``p_word`` is for the other null hypothesis, that the token is spelled as words, names and numbers are: symbols
    of the kinds in ``FOLLOWS``, letters by their shares in prose. The likelihood ratio of the uniform alphabet to
    that model has mean 1 under it, so it is r or more with a probability of at most 1 / r (Markov), whatever the length.

    Each statistic is a column of its own, so that none is computed twice; one fold over the symbols gives the sums.
    """
    core = F.regexp_replace(col, "=+$", "")
    bare = F.replace(core, F.lit("-"), F.lit(""))
    enc = None
    for name, letters, shape in reversed(ENCODINGS):
        fits = (core if name == "base64" else bare).rlike(shape)
        enc = F.when(fits, _constants(name, letters)) if enc is None else F.when(fits, _constants(name, letters)).otherwise(enc)
    t = tokens.withColumn("_e", enc).withColumn("encoding", F.col("_e.name"))
    t = t.withColumn("_t", F.when(F.col("encoding") == "base64", F.translate(core, "-_", "+/")).otherwise(bare)).withColumn("_n", F.length("_t").cast("double"))
    t = t.withColumn("bits", F.col("_n") * F.log2("_e.k"))
    symbols = let(F.struct(F.col("_t").alias("s"), F.col("_e.letters").alias("a")), lambda x: F.transform(F.sequence(F.lit(1), F.length(x["s"])), lambda i: F.instr(x["a"], F.substr(x["s"], i, F.lit(1))) - 1))
    t = t.withColumn("_v", symbols)
    n, k = F.col("_n"), F.col("_e.k")
    follows = F.array(*(F.lit(math.log(x)) for row in FOLLOWS for x in row))
    zero = {"sum": F.lit(0.0), "squares": F.lit(0.0), "lagged": F.lit(0.0), "high": F.lit(0.0), "turns": F.lit(1.0), "prose": F.lit(0.0), "words": F.lit(0.0), "last": F.lit(-1), "kind": F.lit(3)}

    def step(s: Column, v: Column) -> Column:
        first, up, was_up, kind = s["last"] < 0, v >= k / 2, s["last"] >= k / 2, F.get("_e.kinds", v)
        now = {
            "sum": s["sum"] + v, "squares": s["squares"] + v * v, "lagged": s["lagged"] + F.when(first, 0).otherwise(v * s["last"]), "high": s["high"] + up.cast("double"),
            "turns": s["turns"] + (~first & (up != was_up)).cast("double"), "prose": s["prose"] + F.get("_e.scores", v),
            "words": s["words"] + F.get("_e.words", v) + F.get(F.col("_follows"), s["kind"] * 4 + kind), "last": v, "kind": kind,
        }
        return F.struct(*(x.alias(name) for name, x in now.items()))

    t = t.withColumn("_follows", follows).withColumn("_s", F.aggregate("_v", F.struct(*(x.alias(name) for name, x in zero.items())), step))
    counts = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda a: F.size(F.filter("_v", lambda v: v == a)))
    common = F.size(F.filter(F.sequence(F.lit(1), F.size("_v") - 1), lambda i: F.lower(F.substr("_t", i, F.lit(2))).isin(PAIRS)))
    small, letters = (F.length(F.regexp_replace("_t", other, "")).cast("double") for other in ("[^a-z]", "[^A-Za-z]"))
    t = t.withColumns({"_chi": F.aggregate(counts, F.lit(0.0), lambda s, c: s + (c - n / k) * (c - n / k) / (n / k)), "_common": common.cast("double"), "_small": small, "_letters": letters})
    s, letters, high = (lambda name: F.col(f"_s.{name}")), F.col("_letters"), F.col("_s.high")
    avg, ends = s("sum") / n, F.get("_v", F.lit(0)) + s("last")
    t = t.withColumns({"_mean": 2 * (n - high) * high / n + 1, "_around": s("squares") - n * avg * avg, "_lagged": s("lagged") - avg * (2 * s("sum") - ends) + (n - 1) * avg * avg})
    t = t.withColumns({
        "_of": F.when(F.col("_e.cases"), letters).otherwise(n), "_part": F.when(F.col("_e.cases"), F.col("_small")).otherwise(letters), "_share": F.when(F.col("_e.cases"), 0.5).otherwise(F.col("_e.share")),
        "_var": (F.col("_mean") - 1) * (F.col("_mean") - 2) / (n - 1),
    })
    df, of, share = k - 1, F.col("_of"), F.col("_share")
    t = t.withColumns({
        "_z0": (F.pow(F.col("_chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "_z1": F.when(F.col("_var") > 0, (s("turns") - F.col("_mean")) / F.sqrt(F.greatest("_var", F.lit(1e-9)))).otherwise(F.lit(9.0)),
        "_z2": F.when(F.col("_around") > 1e-6, (F.col("_lagged") / F.greatest("_around", F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)),
        "_z3": F.when(of > 0, (F.col("_part") - of * share) / F.sqrt(F.greatest(of, F.lit(1.0)) * share * (1 - share))).otherwise(0.0),
        "_z4": F.when(letters > 0, s("prose") / F.col("_e.sd") / F.sqrt(F.greatest(letters, F.lit(1.0)))).otherwise(0.0),
        "_z5": 2 * (F.sqrt("_common") - F.sqrt((n - 1) * F.col("_e.pair"))),
    })
    tails = [let(F.col(f"_z{j}"), _normal_tail) if j in (0, 4, 5) else let(F.abs(f"_z{j}"), lambda z: 2 * _normal_tail(z)) for j in range(6)]
    t = t.withColumn("_h", F.greatest(-sum((F.log(x) for x in tails), F.lit(0.0)) * 2 / 3, F.lit(0.0)))
    h = F.col("_h")
    ratio = -n * F.log(k) - s("words")
    t = t.withColumns({"p": F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6), "p_word": F.exp(F.greatest(F.least(-ratio, F.lit(0.0)), F.lit(-90.0)))})
    return t.select(*tokens.columns, "encoding", "bits", "p", "p_word")


def _step(p: str) -> Column:
    """The place of a probability on the grid, rounded up."""
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * STEPS)


def not_random(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """``(encoding, octave, most)``: the grid step of ``p`` from which tokens of a stratum are dismissed.

    Each distinct token is one test, however many copies of it ``tokens`` has. With ``step`` from ``p_word`` the
    discovery is that a token is not words, so that at most ``rate`` of the alarms are false.
    Benjamini and Hochberg's rule by encoding and octave of length, where the discovery is that a token is
    not random: among the dismissed at most ``rate`` are random in the mean. p-values are counted on a grid of
    ``STEPS`` a decade (rounded up), so that a stratum of any size is at most 321 counts.
    """
    by = Window.partitionBy("encoding", "octave")
    c = tokens.select("encoding", "octave", "step", "token").distinct().groupBy("encoding", "octave", "step").agg(F.count("*").alias("n"))
    c = c.withColumn("m", F.sum("n").over(by)).withColumn("below", F.sum("n").over(by.orderBy(F.desc("step"))))
    ok = F.col("m") * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("below")
    return c.where(ok).groupBy("encoding", "octave").agg(F.min("step").alias("most"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``(id, k1, k2, base, all)`` for each row of ``docs``: sorted spans of the base scan, and of both scans.

    Spans are ``(start, rank, end)`` in code points, the end exclusive; ``rank`` counts in ``KINDS``. The base
    scan takes the matches of each kind, leftmost and without overlap, and drops those too short. Further runs
    of letters, digits and ``+/_-`` off the base spans are put to the battery where their encoding gives them at
    least ``MIN_BITS`` bits. A run gets kind ``random`` if it isn't found to be regular and is found not to be words:
    both are discoveries of ``not_random``'s rule by encoding and length over the distinct tokens of all documents,
    the second with the hypotheses exchanged, so that false alarms and dismissed secrets are both held to ``rate``.

    Null and empty texts have no spans. Ids may be of any type. Rows repeated with id and text have the same spans
    each. ``(k1, k2)`` is a null-safe key of id and text. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), text.alias("text"))
    shortest = min(math.ceil(MIN_BITS / math.log2(len(letters))) for _, letters, _ in ENCODINGS)
    runs = rf"[A-Za-z0-9+/_-]{{{shortest},}}"
    base = F.array_sort(F.concat(*(_base_spans(F.col("text"), r) for r in range(len(BASE)))))
    more = _places(F.col("text"), runs, len(BASE))
    both = let(base, lambda b: let(more, lambda m: F.struct(b.alias("base"), _outside(m, b).alias("more"))))

    def apart(m: Column) -> Column:
        return F.struct(F.struct(*(m[k].alias(k) for k in ("start", "rank", "end"))).alias("span"), m["token"].alias("token"))

    found = d.select("id", "k1", "k2", let(both, lambda x: F.struct(x["base"].alias("base"), F.transform(x["more"], apart).alias("more"))).alias("f"))
    found = materialize(found.select("id", "k1", "k2", "f.base", "f.more"), "secrets")
    runs = found.where(F.size("more") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.inline("more"))
    tokens = battery(runs).where(F.col("bits") >= MIN_BITS).withColumns({"octave": F.floor(F.log2(F.length("token"))), "step": _step("p"), "word_step": _step("p_word")})
    tokens = materialize(tokens.select("k1", "k2", "span", "token", "encoding", "octave", "step", "word_step"), "tokens")
    # both tables of limits have at most one row for each encoding and octave of length
    regular = not_random(tokens, rate)
    secret = not_random(tokens.drop("step").withColumnRenamed("word_step", "step"), rate).withColumnRenamed("most", "least")
    kept = tokens.join(F.broadcast(regular), ["encoding", "octave"], "left").join(F.broadcast(secret), ["encoding", "octave"])
    kept = kept.where((F.col("most").isNull() | (F.col("step") < F.col("most"))) & (F.col("word_step") >= F.col("least")))
    kept = kept.groupBy("k1", "k2").agg(F.collect_list("span").alias("random"))
    out = found.select("id", "k1", "k2", "base").join(kept, ["k1", "k2"], "left")
    return out.select("id", "k1", "k2", "base", F.array_sort(F.concat("base", F.coalesce("random", F.array().cast(_SPAN)))).alias("all"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` of ``scan_secrets``."""
    s = scan_secrets(docs, id_col, text_col)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")

    return s.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("all")).alias("spans"),
    )


def _cut_out(text: Column, spans: Column, mark: str, pieces: int = PIECES) -> Column:
    """The text with ``mark`` for each of the sorted spans, and one for spans that overlap.

    What stays is the pieces between the spans. A piece is counted from the start of its stretch of ``pieces`` and only
    the stretch from the start of the text, so that a long text with many spans isn't read once for each.
    """

    def between(reach: Column) -> Column:  # reach[i] is the end of all spans before the i-th
        gaps = F.transform(spans, lambda s, i: F.struct(F.get(reach, i).alias("at"), s["start"].alias("to")))
        rest = F.struct(F.get(reach, F.size(spans)).alias("at"), F.length(text).alias("to"))
        return F.concat(F.filter(gaps, lambda g: g["at"] <= g["to"]), F.array(rest))

    def stretches(gaps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / pieces).cast("int")), lambda b: F.slice(gaps, b * pieces + 1, F.lit(pieces)))

    def joined(gaps: Column) -> Column:
        begin = F.get(gaps, F.lit(0))["at"]
        stretch = F.struct(begin.alias("at"), F.substr(text, begin + 1, F.element_at(gaps, -1)["to"] - begin).alias("text"))
        return let(stretch, lambda x: F.array_join(F.transform(gaps, lambda g: F.substr(x["text"], g["at"] - x["at"] + 1, g["to"] - g["at"])), mark))

    reach = running(F.concat(F.transform(spans, lambda s: s["end"]), F.array(F.lit(0))), F.lit(0), lambda s, v: F.greatest(s, v))
    return let(let(reach, between), lambda gaps: F.array_join(F.transform(stretches(gaps), joined), mark))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` replaced by ``mark``, overlapping spans by one; nothing else changes."""
    s = scan_secrets(docs, id_col, text_col).where(F.size("all") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", "all")
    s = materialize(s, "redact")
    side = F.broadcast(s) if s.count() <= BROADCAST_ROWS else s
    k1, k2, spans = fresh(docs, "k1", "k2", "spans")
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(id_col, text_col), strict=True)))
    both = keyed.join(side.toDF(k1, k2, spans), [k1, k2], "left")
    text = F.col(text_col)
    clean = _cut_out(text, F.col(spans), mark)
    return both.withColumn(text_col, F.when(F.col(spans).isNotNull(), clean).otherwise(text)).select(docs.columns)
