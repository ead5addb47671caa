"""URL rules: hosts by equality of reversed parent domains, paths by a sort-merge range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules of one host up to which the rule table is broadcast; a rule is two short strings and a verdict.
BROADCAST_RULES = 50_000
#: Distinct URL keys of one host that one sweep takes, in the mean; more where the host has many rules, as each sweep reads them all.
SWEEP_ROWS, SWEEP_RULES = 2_000, 10


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, verdict)`` rows of rules."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(url):
    """``(host, path)`` columns; both empty without ``://``. Host letters A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.substr(url, (at + 3).cast("int"))
    has = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def reversed_host(host):
    """Host labels from the right, so that a domain is a prefix of its subdomains."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ",")


def _boundaries(rules: DataFrame) -> DataFrame:
    """``(key, at, kind, top)``: where the innermost active rule of a host key changes, and which it is from there on.

    Paths that begin with a rule's path are the interval from the path to the path with a byte 0xFF, which no
    UTF-8 text holds. Intervals of one key nest or are disjoint. One sorted sweep keeps the stack of active rules: a
    start pushes its rule, an end pops it, and the running sum of both is the height. What lies at some height of the
    stack is the last rule pushed to that height, so the top after an end is the last start of the height that is
    left. Both passes sort the rules of a key and look at each once, however deep they nest.
    """
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of contradicting twins, block goes before allow
    r = r.select(reversed_host(F.col("host")).alias("key"), F.col("path").cast("binary").alias("path"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("rule"))
    start = F.struct(F.col("path").alias("at"), F.lit(1).alias("kind"), F.col("rule").alias("pushed"))
    end = F.struct(F.concat("path", F.lit(b"\xff")).alias("at"), F.lit(0).alias("kind"), F.when(F.lit(False), F.col("rule")).alias("pushed"))
    events = r.select("key", F.inline(F.array(start, end)))
    sweep = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("height", F.sum(F.col("kind") * 2 - 1).over(sweep))
    slot = Window.partitionBy("key", "height").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("height") > 0, F.last("pushed", ignorenulls=True).over(slot))
    return events.select("key", "at", "kind", top.alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)``, a row for each row of ``pages``.

    Null hosts and paths of rules fit nothing; of contradicting rules with one host and path, block goes before allow.
    A rule ``(host, path, verdict)`` fits its host and every subdomain where the URL's path begins with the
    rule's path. Of fitting rules the one with the longest host and path wins; of equally long ones the
    longer host. Without one the rule is null and the verdict ``default``. Null URLs and those without
    ``://`` have an empty host and path. Ids may be of any type, equal and null; repeated rows stay. Empty tables of
    pages or rules are fine. Other columns are not read.

    Plan: every URL is probed under its host and each parent domain, reversed, that has rules. Distinct
    probes and the rules' boundaries are sorted together by key and path; one sweep hands each probe the top
    of the stack at the last boundary before it. A key that half of all URLs share, like a top-level domain,
    is split by a hash of the path over as many sweeps as its rows need, and each gets the key's boundaries.
    """
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    bounds = _boundaries(rules)
    n_rules = rules.count()
    keys = bounds.select("key").distinct()
    urls = p.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), ","))
    probes = urls.select("host", "path", F.explode(parents).alias("key"))
    probes = probes.join(F.broadcast(keys) if n_rules <= BROADCAST_RULES else keys, "key", "left_semi")
    # how many sweeps a key needs
    sweeps = probes.groupBy("key").agg(F.count("*").alias("n")).join(bounds.groupBy("key").agg(F.count("*").alias("b")), "key")
    sweeps = sweeps.select("key", F.ceil(F.col("n") / F.greatest(F.lit(SWEEP_ROWS), F.col("b") * SWEEP_RULES)).cast("int").alias("sweeps"))
    sweeps = F.broadcast(sweeps) if n_rules <= BROADCAST_RULES else sweeps
    dealt = probes.join(sweeps, "key").select(
        "key", F.pmod(F.xxhash64("path"), F.col("sweeps")).cast("int").alias("sweep"), F.col("path").cast("binary").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("top"), "host", "path"
    )
    copies = bounds.join(sweeps, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), "at", "kind", "top", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")
    )
    # the top after the last boundary: a struct around it tells an emptied stack from no boundary
    order = Window.partitionBy("key", "sweep").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    boxed = F.when(F.col("kind") < 2, F.struct("top"))
    swept = dealt.unionByName(copies).withColumn("found", F.last(boxed, ignorenulls=True).over(order))
    hits = swept.where((F.col("kind") == 2) & F.col("found.top").isNotNull())
    best = hits.groupBy("host", "path").agg(F.max_by("found.top", F.struct(F.length("found.top.rule"), F.length("key"))).alias("top"))
    out = p.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
