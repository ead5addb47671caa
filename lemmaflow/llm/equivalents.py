"""DuckDB SQL for the rows of op3, op5 and op8, over whole tables, by plain definitions instead of the operators' methods."""

from __future__ import annotations

from .quality import DUPLICATE_LINES, DUPLICATE_NGRAMS, TOP_NGRAM
from .simhash import SEED
from .suffix_dedup import LENGTH

# Fixed values of XXH64.
PRIME1, PRIME2, PRIME3, PRIME4, PRIME5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def repeats_sql(length: int = LENGTH, piece: int = 1000) -> str:
    """Every string of ``length`` bytes by its MD5; the ones that start twice cover what goes. Texts are read in pieces, whole."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS hx FROM documents),
pieces AS (SELECT r, n, p, substr(hx, 2 * p + 1, {2 * (piece + length - 1)}) AS px FROM (SELECT r, n, hx, unnest(range(0, n, {piece})) AS p FROM d WHERE n >= {length})),
starts AS (SELECT r, p + i AS pos, md5(substr(px, 2 * i + 1, {2 * length})) AS digest
  FROM (SELECT r, n, p, px, unnest(range(0, least({piece}, n - p - {length} + 1))) AS i FROM pieces)),
twice AS (SELECT digest FROM starts GROUP BY digest HAVING count(*) > 1),
hits AS (SELECT r, pos, coalesce(pos > lag(pos) OVER (PARTITION BY r ORDER BY pos) + {length}, true) AS fresh FROM starts SEMI JOIN twice USING (digest)),
runs AS (SELECT r, pos, sum(fresh::INT) OVER (PARTITION BY r ORDER BY pos) AS run FROM hits),
spans AS (SELECT r, min(pos) AS b, max(pos) + {length} AS e FROM runs GROUP BY r, run),
gone AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
edges AS (SELECT r, b, e FROM spans UNION ALL SELECT r, n, n FROM d),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b, e), 0) AS f, b AS t FROM edges),
kept AS (SELECT r, string_agg(substr(hx, 2 * f + 1, 2 * (t - f)), '' ORDER BY f, t) AS kx FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kx)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""


def _u(x: object) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _low(x: str) -> str:
    return f"(({x}) & {_u(2**64 - 1)})"


def _times(x: str, prime: int) -> str:
    return _low(f"({x}) * {_u(prime)}")


def _rotated(x: str, by: int) -> str:
    """``x`` below 2^64, rotated left."""
    return _low(f"(({x}) << {by}) | (({x}) >> {64 - by})")


def _little(at: str, size: int) -> str:
    """The number in ``size`` bytes of the hexadecimal text ``hx`` from byte ``at``, lowest byte first."""
    return "CAST('0x' || " + " || ".join(f"substr(hx, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"


def xxh64_ctes(source: str, seed: int = SEED) -> str:
    """CTEs that end in ``hashed(sh, h)``, the XXH64 of each text ``sh`` of ``source``; each step is a CTE, so that it is computed once."""
    # list_reduce folds from the first element, which is the state before the first lane
    steps = [f"bytes AS (SELECT sh, hex(encode(sh)) AS hx, strlen(sh) AS n FROM {source})"]
    steps.append(f"lanes AS (SELECT *, list_transform(range(0, n // 8), lambda j: {_little('8 * j', 8)}) AS l8 FROM bytes)")
    begin = [(seed + PRIME1 + PRIME2) % 2**64, (seed + PRIME2) % 2**64, seed, (seed - PRIME1) % 2**64]

    def fold(first: str, items: str, first_step: str, by: int, then: str) -> str:
        # a step is: mix the item in, rotate, finish; `first_step` and `then` hold {a}, {b} or {x}
        mixed = first_step.format(a="a", b="b")
        return f"list_reduce(list_concat([{first}], {items}), lambda a, b: {then.format(x=_rotated(mixed, by))})"

    stripes = ", ".join(
        fold(_u(v), f"list_transform(range(0, n // 32), lambda s: l8[4 * s + {k + 1}])", _low("{a} + {b} * " + _u(PRIME2)), 31, _times("{x}", PRIME1)) + f" AS v{k}"
        for k, v in enumerate(begin)
    )
    steps.append(f"stripes AS (SELECT sh, hx, n, l8, {stripes} FROM lanes)")
    joined = _low(" + ".join(_rotated(f"v{k}", by) for k, by in enumerate((1, 7, 12, 18))))
    steps.append(f"joined AS (SELECT *, CASE WHEN n < 32 THEN {_u((seed + PRIME5) % 2**64)} ELSE {joined} END AS h FROM stripes)")
    for k in range(4):
        lane = _times(_rotated(_times(f"v{k}", PRIME2), 31), PRIME1)
        merged = _low(_times(f"xor(h, {lane})", PRIME1) + f" + {_u(PRIME4)}")
        steps.append(f"merged{k} AS (SELECT * REPLACE (CASE WHEN n < 32 THEN h ELSE {merged} END AS h) FROM {'joined' if k == 0 else f'merged{k - 1}'})")
    rest = f"list_transform(l8[4 * (n // 32) + 1:], lambda x: {_times(_rotated(_times('x', PRIME2), 31), PRIME1)})"
    steps.append("eights AS (SELECT * REPLACE (" + fold(_low("h + n::UHUGEINT"), rest, "xor({a}, {b})", 27, _low(_times("{x}", PRIME1) + f" + {_u(PRIME4)}")) + " AS h) FROM merged3)")
    four = _low(_times(_rotated(f"xor(h, {_times(_little('8 * (n // 8)', 4), PRIME1)})", 23), PRIME2) + f" + {_u(PRIME3)}")
    steps.append(f"fours AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h) FROM eights)")
    single = f"list_transform(range(n - n % 4, n), lambda j: {_times(_little('j', 1), PRIME5)})"
    steps.append("ones AS (SELECT * REPLACE (" + fold("h", single, "xor({a}, {b})", 11, _times("{x}", PRIME1)) + " AS h) FROM fours)")
    steps.append(f"turned AS (SELECT sh, {_times('xor(h, h >> 33)', PRIME2)} AS h FROM ones)")
    steps.append(f"again AS (SELECT sh, {_times('xor(h, h >> 29)', PRIME3)} AS h FROM turned)")
    steps.append("hashed AS (SELECT sh, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM again)")
    return ",\n".join(steps)


def simhash_sql(seed: int = SEED, bits: int = 2) -> str:
    """Fingerprints with XXH64 in SQL; all pairs of distinct fingerprints, and what is reachable."""
    majority = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {2**b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
shingles AS (SELECT r, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
texts AS (SELECT DISTINCT sh FROM shingles),
{xxh64_ctes("texts", seed)},
voted AS (SELECT r, CAST({majority} AS UBIGINT) AS p FROM shingles JOIN hashed USING (sh) GROUP BY r),
prints AS (SELECT r, doc_id, coalesce(p, 0::UBIGINT) AS p FROM d LEFT JOIN voted USING (r)),
nodes AS (SELECT p, min(doc_id) AS first FROM prints GROUP BY p),
links AS (SELECT a.p AS a, b.p AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.p, b.p)) <= {bits}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS p, min(first) AS component_id FROM reach JOIN nodes ON reach.b = nodes.p GROUP BY a)
SELECT doc_id, lower(lpad(hex(p), 16, '0')) AS fingerprint, component_id FROM prints JOIN parts USING (p)
"""


def quality_sql(min_words: int = 50, max_repeat: int = 50) -> str:
    """The n-grams themselves instead of their hashes."""

    def cases(thresholds: dict[int, float]) -> str:
        return "CASE n " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in thresholds.items()) + " END"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_WORD}) AS ws FROM d),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS j, length(unnest(ws)) AS chars FROM w),
base AS (SELECT r, doc_id, t, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k, strlen(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')) AS bytes
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD})),
line_sums AS (SELECT r, count(*) FILTER (k > 1) AS n_dup_lines, (coalesce(sum(bytes) FILTER (k > 1), 0)::DOUBLE / sum(bytes)::DOUBLE) AS dup_line_share FROM lines GROUP BY r),
grams AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, range(2, 11) s(n) WHERE len(ws) >= 3 AND len(ws) >= n)),
counted AS (SELECT r, n, i, gram, count(*) OVER same AS c, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS k FROM grams WINDOW same AS (PARTITION BY r, n, gram)),
top AS (SELECT r, n, max(c * (length(gram) - n + 1)) AS mass FROM counted WHERE c > 1 AND n <= {max(TOP_NGRAM)} GROUP BY r, n),
repeated AS (SELECT DISTINCT r, unnest(range(i, i + 3)) AS j FROM counted WHERE n = 3 AND c > 1),
repeats AS (SELECT r, count(*) AS n_repeat_words FROM repeated GROUP BY r),
later AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS j FROM counted WHERE n >= {min(DUPLICATE_NGRAMS)} AND k > 1),
covered AS (SELECT r, n, sum(chars) AS chars FROM later JOIN words USING (r, j) GROUP BY r, n),
tops AS (SELECT r, max(mass::DOUBLE / word_chars::DOUBLE / {cases(TOP_NGRAM)}) AS top_ngram_excess FROM top JOIN base USING (r) GROUP BY r),
dups AS (SELECT r, max(chars::DOUBLE / word_chars::DOUBLE / {cases(DUPLICATE_NGRAMS)}) AS dup_ngram_excess FROM covered JOIN base USING (r) GROUP BY r),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(dup_line_share, 0) AS dup_line_share, coalesce(top_ngram_excess, 0) AS top_ngram_excess, coalesce(dup_ngram_excess, 0) AS dup_ngram_excess
  FROM base LEFT JOIN line_sums USING (r) LEFT JOIN repeats USING (r) LEFT JOIN tops USING (r) LEFT JOIN dups USING (r))
SELECT *, NOT base_failed AND dup_line_share <= {DUPLICATE_LINES}::DOUBLE AND top_ngram_excess <= 1 AND dup_ngram_excess <= 1 AS kept
FROM (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed FROM m)
"""
