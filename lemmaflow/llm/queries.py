"""The registered queries of the corpus operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_contamination
from .equivalents import quality_sql, repeats_sql, simhash_sql
from .licenses import known_digests, scan_licenses
from .mixing import mix_sources
from .quality import quality_rules
from .secrets import secret_report
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import toxicity
from .urlfilter import judge_urls, rule_table
from .warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]

#: Host, path and verdict of the rules of op7.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that a document, or a line of it, is."""
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of the benchmark."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2", "items")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(LOWER, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS ws
  FROM (SELECT item, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS ws
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, i, dw.l, item FROM dw JOIN bw ON dw.l = bw.l AND dw.ws = bw.ws),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace("\\\\", "\\").replace("LOWER", _LOWER.format("text"))


def _op1_sql() -> str:
    from .license_texts import KNOWN
    from .licenses import SPELLINGS

    flat = "regexp_replace(replace({}, '&', ' and '), '(^|\\n)[\\x20\\t#*/;-]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')".replace("\\\\", "\\")
    flat = f"replace(' ' || regexp_replace({flat}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') || ' ', chr(10), ' ' || chr(10) || ' ')"
    for old, new in SPELLINGS:
        flat = f"replace({flat}, ' {old} ', ' {new} ')"
    lines = f"[y FOR y IN [trim(regexp_replace(x, ' +', ' ', 'g')) FOR x IN string_split({flat}, chr(10))] IF y <> '']".replace("{}", _LOWER.format("coalesce(text, '')"))
    known = ", ".join("('{}', '{}')".format(*(v.replace("'", "''") for v in row)) for row in KNOWN)
    return f"""
WITH k AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license) AS license FROM (VALUES {known}) t(license, text) GROUP BY 1),
d AS (SELECT doc_id, {lines} AS c FROM documents),
w AS (SELECT doc_id, c, sha256(array_to_string(c, ' ')) AS text_digest FROM d),
l AS (SELECT doc_id, count(*) AS n, list(license) AS names FROM (SELECT doc_id, sha256(x) AS digest, license FROM (SELECT doc_id, unnest(list_distinct(c)) AS x FROM d) JOIN k ON sha256(x) = k.digest) GROUP BY doc_id)
SELECT doc_id, text_digest, k.license AS text_license, coalesce(n, 0) AS n_license_lines,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), CASE WHEN k.license IS NULL THEN [] ELSE [k.license] END))), ',') AS licenses
FROM w LEFT JOIN k ON text_digest = k.digest LEFT JOIN l USING (doc_id)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, and the random strings beside them."""
    return secret_report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back in the order of captures."""
    return archive_pages(table(spark, sf_dir, "pages")).drop("file", "offset", "length")  # where the member is; the names are new each time


OP6_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host FROM pages)
SELECT page_id, url, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
  strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured,
  coalesce(CASE WHEN host IS NOT NULL THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(url, '://[^/?#]*(.*)$', 1) ELSE url END, '') AS url_key
FROM p LEFT JOIN f ON p.digest = f.digest JOIN u USING (page_id)
"""


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


OP7_SQL = """
WITH u AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT host, path, arg_max(struct_pack(rule := rhost || rpath, v := v), length(rhost || rpath)) AS best
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix of sources."""
    return mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": op1_licenses,
        "op2_decontamination": op2_decontamination,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_secrets": op4_secrets,
        "op5_simhash": op5_simhash,
        "op6_warc": op6_warc,
        "op7_url_filters": op7_url_filters,
        "op8_quality": op8_quality,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": _op1_sql(),
        "op2_decontamination": OP2_SQL,
        "op3_suffix_dedup": repeats_sql(),
        "op5_simhash": simhash_sql(),
        "op6_warc": OP6_SQL,
        "op7_url_filters": OP7_SQL,
        "op8_quality": quality_sql(),
    }
