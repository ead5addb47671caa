"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import bitmaps, sequences, words
from .operators import bitvectors, stats, wavelets, zorder
from .operators import sequences as long_sequences
from .operators.ordered import following
from .plans.program import BOOLEAN, MAX_MIN, MAX_TIMES, Program, Relation, Semiring, problem
from .plans.terms import combine, no, row, variables
from .sources.tables import bit_words, literal, materialize, parquet, scratch_path
from .streaming.trim import trimmed_summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
X, Y, Z, W = variables("X Y Z W")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Rules: graphs over the driver's tables

HIERARCHY_SQL = """
SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"""

TRANSITIONS_SQL = """
SELECT a AS src, b AS dst, CAST(round(min(w) * 100) AS BIGINT) AS w FROM (
  SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b, lead(value) OVER (ORDER BY ts, event_id) AS w
  FROM events WHERE event_type = 'error' AND value > 100) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to customer to nation to region, and supplier to nation: an acyclic graph of three levels."""

    def edges(name: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        return parquet(spark, sf_dir, name).select(F.concat(F.lit(src[0]), F.col(src[1])).alias("src"), F.concat(F.lit(dst[0]), F.col(dst[1])).alias("dst"))

    return (
        edges("nation", ("n", "n_nationkey"), ("r", "n_regionkey")).union(edges("customer", ("c", "c_custkey"), ("n", "c_nationkey")))
        .union(edges("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"))).union(edges("orders", ("o", "o_orderkey"), ("c", "o_custkey")))
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of one rare error event to the next one's: a cyclic weighted graph, weights in cents."""
    e = parquet(spark, sf_dir, "events").where("event_type = 'error' and value > 100").select("ts", "event_id", "user_id", "value")
    e = following(e, ["ts", "event_id"], {"dst": "user_id", "v": "value"}, F.date_trunc("day", F.col("ts").cast("timestamp")))
    e = e.withColumnRenamed("user_id", "src").where("dst is not null and src <> dst")
    return e.groupBy("src", "dst").agg(F.round(F.min("v") * 100).cast("long").alias("w"))


def _closure(spark: SparkSession, edges: DataFrame, kind: str):
    p = Program(spark)
    edge = p.table("edge", f"src {kind}, dst {kind}", data=edges.select("src", "dst"))
    tc = p.table("tc", f"src {kind}, dst {kind}")
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) & edge(Y, Z))
    return p, edge, tc


def _hier(spark: SparkSession, sf_dir: str):
    return _closure(spark, hierarchy(spark, sf_dir), "string")


def _cyclic(spark: SparkSession, sf_dir: str):
    return _closure(spark, transitions(spark, sf_dir), "bigint")


def _tc_sql(edges: str, rest: str) -> str:
    return f"WITH RECURSIVE edge AS ({edges}), tc(src, dst) AS (SELECT src, dst FROM edge UNION SELECT tc.src, edge.dst FROM tc JOIN edge ON tc.dst = edge.src) {rest}"


def _places(spark: SparkSession, sf_dir: str):
    """A program with the nation, customer and supplier tables as relations."""
    p = Program(spark)
    nation = p.table("nation", "nation int, name string, region int", data=parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    customer = p.table("customer", "customer bigint, nation int, segment string", data=parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    supplier = p.table("supplier", "supplier bigint, nation int", data=parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    region = p.table("region", "region int, name string", data=parquet(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    orders = p.table("orders", "order bigint, customer bigint, status string", data=parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return p, nation, customer, supplier, region, orders


@query("SELECT DISTINCT n_nationkey AS X, n_name AS Y, n_regionkey AS Z FROM nation")
def dl_fact_scan(spark, sf_dir):
    p, nation, *_ = _places(spark, sf_dir)
    return p.query(nation(X, Y, Z))


@query("SELECT DISTINCT c_custkey AS X, c_nationkey AS Y FROM customer WHERE c_mktsegment = 'BUILDING'")
def dl_const_select(spark, sf_dir):
    p, _, customer, *_ = _places(spark, sf_dir)
    return p.query(customer(X, Y, "BUILDING"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer")
def dl_project_distinct(spark, sf_dir):
    p, _, customer, *_ = _places(spark, sf_dir)
    at = p.table("at", "nation int")
    p.rule(at(Y), customer(X, Y, Z))
    return p.query(row(at(X)))


@query("SELECT DISTINCT c_custkey AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dl_join_chain(spark, sf_dir):
    p, nation, customer, _, region, _ = _places(spark, sf_dir)
    lives = p.table("lives", "customer bigint, region string")
    n, s, m = variables("N S M")
    p.rule(lives(X, Y), customer(X, n, s) & nation(n, m, Z) & region(Z, Y))
    return p.query(row(lives(X, Y)))


@query("SELECT DISTINCT a.n_nationkey AS X, b.n_nationkey AS Y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def dl_self_join(spark, sf_dir):
    p, nation, *_ = _places(spark, sf_dir)
    near = p.table("near", "a int, b int")
    m, n = variables("M N")
    p.rule(near(X, Y), nation(X, m, Z) & nation(Y, n, Z))
    return p.query(near(X, Y))


@query("SELECT DISTINCT r_regionkey AS X, n_nationkey AS Y FROM region, nation")
def dl_cross(spark, sf_dir):
    p, nation, _, _, region, _ = _places(spark, sf_dir)
    pair = p.table("pair", "a int, b int")
    m, n, k = variables("M N K")
    p.rule(pair(X, Y), region(X, m) & nation(Y, n, k))
    return p.query(pair(X, Y))


@query("SELECT DISTINCT n_nationkey AS X FROM nation WHERE n_nationkey = n_regionkey")
def dl_repeated_var(spark, sf_dir):
    p, nation, *_ = _places(spark, sf_dir)
    return p.query(nation(X, Y, X)).select("X")


@query("SELECT n_nationkey AS X FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def dl_union_or(spark, sf_dir):
    p, nation, customer, supplier, *_ = _places(spark, sf_dir)
    used = p.table("used", "nation int")
    m, n, k, s = variables("M N K S")
    p.rule(used(X), nation(X, m, n) & (customer(k, X, s) | supplier(k, X)))
    return p.query(used(X))


@query("SELECT c_custkey AS X, c_nationkey AS Y FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier")
def dl_multi_rule(spark, sf_dir):
    p, _, customer, supplier, *_ = _places(spark, sf_dir)
    party = p.table("party", "id bigint, nation int")
    p.rule(party(X, Y), customer(X, Y, Z))
    p.rule(party(X, Y), supplier(X, Y))
    return p.query(party(X, Y))


@query("SELECT DISTINCT s_nationkey AS nation, s_suppkey AS supplier FROM supplier")
def dl_inverse(spark, sf_dir):
    p, _, _, supplier, *_ = _places(spark, sf_dir)
    hosts = p.table("hosts", "nation int, supplier bigint")
    p.rule(hosts(Y, X), supplier(X, Y))
    return p.query(row(hosts(X, Y)))


@query("SELECT DISTINCT c_custkey AS X FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def dl_negation(spark, sf_dir):
    p, _, customer, _, _, orders = _places(spark, sf_dir)
    buyer, idle = p.table("buyer", "customer bigint"), p.table("idle", "customer bigint")
    p.rule(buyer(X), orders(Y, X, Z))
    p.rule(idle(X), customer(X, Y, Z) & no(buyer(X)))
    return p.query(idle(X))


@query("SELECT DISTINCT o_custkey AS X FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F')")
def dl_negation_const(spark, sf_dir):
    p, _, _, _, _, orders = _places(spark, sf_dir)
    has = p.table("has", "customer bigint, status string")
    p.rule(has(X, Z), orders(Y, X, Z))
    return p.query(has(X, Y) & no(has(X, "F"))).select("X").distinct()


@query(_tc_sql(HIERARCHY_SQL, "SELECT src AS X, dst AS Y FROM tc"))
def dl_tc_hier(spark, sf_dir):
    p, _, tc = _hier(spark, sf_dir)
    return p.query(tc(X, Y))


@query(_tc_sql(TRANSITIONS_SQL, "SELECT src AS X, dst AS Y FROM tc"))
def dl_tc_cyclic(spark, sf_dir):
    """The full closure: its rows are its size, so it is a check of correctness; ask bound goals of large graphs."""
    p, _, tc = _cyclic(spark, sf_dir)
    return p.query(tc(X, Y))


@query(f"WITH RECURSIVE edge AS ({TRANSITIONS_SQL}), tc(dst) AS (SELECT dst FROM edge WHERE src = (SELECT min(src) FROM edge) UNION SELECT edge.dst FROM tc JOIN edge ON tc.dst = edge.src) SELECT dst AS X FROM tc")
def dl_tc_bound(spark, sf_dir):
    """What one node reaches: the goal's constant seeds the recursion."""
    p, _, tc = _cyclic(spark, sf_dir)
    first = transitions(spark, sf_dir).agg(F.min("src")).first()[0]
    return p.query(tc(first, X))


@query(f"WITH RECURSIVE edge AS ({TRANSITIONS_SQL}), tc(dst) AS (SELECT dst FROM edge WHERE src = (SELECT min(src) FROM edge) UNION SELECT edge.dst FROM tc JOIN edge ON tc.dst = edge.src) SELECT dst AS X FROM tc")
def dl_tc_bound_right(spark, sf_dir):
    """The same with the recursive literal last: a relation of asked-for nodes keeps the rest out."""
    p = Program(spark)
    edges = transitions(spark, sf_dir)
    edge = p.table("edge", "src bigint, dst bigint", data=edges.select("src", "dst"))
    tc = p.table("tc", "src bigint, dst bigint")
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), edge(X, Y) & tc(Y, Z))
    return p.query(tc(edges.agg(F.min("src")).first()[0], X))


@query(
    f"WITH RECURSIVE edge AS ({TRANSITIONS_SQL}), tc(src, dst) AS (SELECT src, dst FROM edge UNION SELECT tc.src, edge.dst FROM tc JOIN edge ON tc.dst = edge.src), "
    "nodes AS (SELECT src AS x FROM edge UNION SELECT dst FROM edge) SELECT x AS X FROM nodes WHERE NOT EXISTS (SELECT 1 FROM tc WHERE src = x AND dst = x)"
)
def dl_cyclic_acyclic(spark, sf_dir):
    p, edge, tc = _cyclic(spark, sf_dir)
    cyclic, acyclic, endpoint = (p.table(n, "x bigint") for n in ("cyclic", "acyclic", "endpoint"))
    p.rule(cyclic(X), tc(X, X))
    p.rule(acyclic(X), (edge(X, Y) | edge(Y, X)) & no(cyclic(X)))
    p.rule(endpoint(X), acyclic(X))
    return p.query(endpoint(X))


@query("""
WITH RECURSIVE rr(a, s) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
ur(u, r) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT u, s FROM ur JOIN rr ON r = rr.a),
rp(r, p) AS (SELECT 'r' || r_regionkey, r_name FROM region UNION SELECT 'n' || n_nationkey, n_name FROM nation)
SELECT u AS user, p AS permission FROM ur JOIN rp ON ur.r = rp.r UNION SELECT 's' || s_suppkey, 'SUPPLY' FROM supplier""")
def dl_rbac(spark, sf_dir):
    """Roles of users by nation and region, and what they permit; facts and rules on one relation."""
    p = Program(spark)

    def name(prefix: str, c: str) -> Column:
        return F.concat(F.lit(prefix), F.col(c))

    nation, region = parquet(spark, sf_dir, "nation"), parquet(spark, sf_dir, "region")
    user_role = p.table("userRole", "user string, role string", data=parquet(spark, sf_dir, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))
    role_role = p.table("roleRole", "role string, sub string", data=nation.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    role_perm = p.table("rolePermissions", "role string, permission string", data=region.select(name("r", "r_regionkey"), "r_name"))
    p.data(role_perm, nation.select(name("n", "n_nationkey"), "n_name"))
    user_perm = p.table("userPermissions", "user string, permission string", data=parquet(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), F.lit("SUPPLY")))
    p.rule(user_role(X, Z), user_role(X, Y) & role_role(Y, Z))
    p.rule(role_role(X, Z), role_role(X, Y) & role_role(Y, Z))
    p.rule(user_perm(X, Z), user_role(X, Y) & role_perm(Y, Z))
    return p.query(row(user_perm(X, Y)))


@query(_tc_sql(HIERARCHY_SQL, "SELECT src, dst FROM tc WHERE dst = 'r1' AND NOT EXISTS (SELECT 1 FROM edge WHERE edge.src = tc.src AND edge.dst = 'r1')"))
def dl_row_query(spark, sf_dir):
    p, edge, tc = _hier(spark, sf_dir)
    return p.query(row(tc(X, "r1")) & no(edge(X, "r1")))


@query(f"""
WITH RECURSIVE edge AS ({HIERARCHY_SQL}), w AS (SELECT src, dst, 1 + length(src) % 7 AS w FROM edge),
d(src, dst, w) AS (SELECT src, dst, w FROM w UNION ALL SELECT d.src, w.dst, d.w + w.w FROM d JOIN w ON d.dst = w.src)
SELECT src, dst, CAST(min(w) AS BIGINT) AS w FROM d GROUP BY 1, 2""")
def dl_min_plus(spark, sf_dir):
    """Shortest distances: values add along a path, the least of equal keys stays."""
    p = Program(spark)
    e = hierarchy(spark, sf_dir).withColumn("w", (1 + F.length("src") % 7).cast("long"))
    edge = p.table("edge", "src string, dst string, w bigint", value="w", merge="min", data=e)
    tc = p.table("tc", "src string, dst string, w bigint", value="w", merge="min")
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) + edge(Y, Z))
    return p.query(row(tc(X, Y)))


@query(f"""
WITH RECURSIVE edge AS ({TRANSITIONS_SQL}), d(dst, w) USING KEY (dst) AS (
  SELECT dst, w FROM edge WHERE src = (SELECT min(src) FROM edge)
  UNION SELECT e.dst, min(d.w + e.w) FROM d JOIN edge e ON d.dst = e.src LEFT JOIN recurring.d AS o ON o.dst = e.dst
  WHERE o.w IS NULL OR d.w + e.w < o.w GROUP BY e.dst)
SELECT (SELECT min(src) FROM edge) AS src, dst, w FROM d""")
def dl_min_plus_cyclic(spark, sf_dir):
    """Shortest distances from one node of a cyclic graph."""
    p = Program(spark)
    e = transitions(spark, sf_dir)
    edge = p.table("edge", "src bigint, dst bigint, w bigint", value="w", merge="min", data=e)
    tc = p.table("tc", "src bigint, dst bigint, w bigint", value="w", merge="min")
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) + edge(Y, Z))
    return p.query(row(tc(e.agg(F.min("src")).first()[0], X)))


@query(f"""
WITH RECURSIVE edge AS ({HIERARCHY_SQL}), d(src, dst, hops) AS (SELECT src, dst, 1 FROM edge UNION SELECT d.src, edge.dst, hops + 1 FROM d JOIN edge ON d.dst = edge.src)
SELECT src, dst, CAST(min(hops) AS BIGINT) AS hops FROM d GROUP BY 1, 2""")
def dl_hops(spark, sf_dir):
    p = Program(spark)
    edge = p.table("edge", "src string, dst string, hops bigint", value="hops", data=hierarchy(spark, sf_dir).withColumn("hops", F.lit(1).cast("long")))
    tc = p.table("tc", "src string, dst string, hops bigint", value="hops", merge="first")
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) + edge(Y, Z))
    return p.query(row(tc(X, Y)))


@query(f"WITH RECURSIVE edge AS ({TRANSITIONS_SQL}), tc(dst) AS (SELECT dst FROM edge WHERE src = (SELECT min(src) FROM edge) UNION SELECT edge.dst FROM tc JOIN edge ON tc.dst = edge.src) SELECT dst AS X FROM tc")
def dl_tc_bound_both(spark, sf_dir):
    """The same with two recursive literals in the rule: only nodes that are reached are asked for."""
    p = Program(spark)
    edges = transitions(spark, sf_dir)
    edge = p.table("edge", "src bigint, dst bigint", data=edges.select("src", "dst"))
    tc = p.table("tc", "src bigint, dst bigint")
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) & tc(Y, Z))
    return p.query(tc(edges.agg(F.min("src")).first()[0], X))


def _paths(spark, sf_dir, semiring: Semiring, kind: str, value: Column) -> DataFrame:
    """Values of all paths of the hierarchy under a semiring."""
    p = Program(spark)
    edge = p.table("edge", f"src string, dst string, v {kind}", value="v", merge=semiring.plus, data=hierarchy(spark, sf_dir).withColumn("v", value))
    tc = p.table("tc", f"src string, dst string, v {kind}", value="v", merge=semiring.plus)
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), combine(semiring.times, tc(X, Y), edge(Y, Z)))
    return p.query(row(tc(X, Y)))


def _paths_sql(value: str, times: str, plus: str) -> str:
    return f"""WITH RECURSIVE edge AS ({HIERARCHY_SQL}), w AS (SELECT src, dst, {value} AS v FROM edge),
d(src, dst, v) AS (SELECT src, dst, v FROM w UNION ALL SELECT d.src, w.dst, {times} FROM d JOIN w ON d.dst = w.src) SELECT src, dst, {plus} AS v FROM d GROUP BY 1, 2"""


@query(_paths_sql("CAST(length(src) % 5 AS BIGINT)", "least(d.v, w.v)", "max(v)"))
def dl_max_min(spark, sf_dir):
    """Widest paths."""
    return _paths(spark, sf_dir, MAX_MIN, "bigint", (F.length("src") % 5).cast("long"))


@query(_paths_sql("CASE WHEN length(src) % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE", "d.v * w.v", "max(v)"))
def dl_max_times(spark, sf_dir):
    """Most reliable paths."""
    return _paths(spark, sf_dir, MAX_TIMES, "double", F.when(F.length("src") % 2 == 0, 0.5).otherwise(0.25))


@query(_paths_sql("length(src) % 4 <> 0", "d.v AND w.v", "bool_or(v)"))
def dl_boolean(spark, sf_dir):
    """Whether a path has only open edges."""
    return _paths(spark, sf_dir, BOOLEAN, "boolean", F.length("src") % 4 != 0)


@query("SELECT DISTINCT n_name AS X, c_mktsegment AS Y FROM nation JOIN customer ON n_nationkey = c_nationkey")
def dl_dynamic_table(spark, sf_dir):
    """Relations without names of their own, made while the program runs."""
    p = Program(spark)
    nation = p.table(None, "nation int, name string", data=parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    customer = p.table(None, "nation int, segment string", data=parquet(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"))
    out = p.table(None, "name string, segment string")
    p.rule(out(Y, Z), nation(X, Y) & customer(X, Z))
    return p.query(out(X, Y))


@query("SELECT DISTINCT n_name || ' in ' || r_name AS row FROM nation JOIN region ON n_regionkey = r_regionkey")
def dl_row_constructor(spark, sf_dir):
    """Answers as values of a relation's own row constructor."""
    p, nation, _, _, region, _ = _places(spark, sf_dir)
    lies = p.table("lies", "nation string, region string", make_row=lambda nation, region: F.concat(nation, F.lit(" in "), region))
    p.rule(lies(Y, W), nation(X, Y, Z) & region(Z, W))
    return p.query(row(lies(X, Y)))


_TOY = [("A", "B"), ("B", "C"), ("B", "A"), ("C", "D"), ("D", "E"), ("E", "F")]


@query("SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) t(X)")
def dl_problem(spark, sf_dir):
    """A program assembled from its facts, rules and goal: what A reaches in the toy graph."""
    edge, tc = (Relation(n, literal(spark, [], "src string, dst string").schema) for n in ("Edge", "TC"))
    rules = [tc(X, Y).when(edge(X, Y)), tc(X, Z).when(tc(X, Y) & edge(Y, Z))]
    return problem(spark, {edge: _TOY}, rules, tc("A", X), [edge, tc])


def _rules(spark):
    edge, tc = (Relation(n, literal(spark, [], "src string, dst string").schema) for n in ("edge", "tc"))
    p, q, r = variables("P Q R")
    return [
        tc(X, Z).when(tc(X, Y) & edge(Y, Z)), tc(p, r).when(tc(p, q) & edge(q, r)), tc(X, Y).when(edge(Y, Z)),
        tc(X, X).when(edge(X, X)), tc(X, Y).when(edge(X, Y) & no(tc(Y, Z))), tc(X, Y).when(edge(X, Y) | edge(Y, X)),
    ]


@query("""SELECT * FROM (VALUES (0, 'tc(X, Z) :- tc(X, Y) & edge(Y, Z)', 'tc(v0, v1) :- tc(v0, v2) & edge(v2, v1)', 3, true, 1), (1, 'tc(P, R) :- tc(P, Q) & edge(Q, R)', 'tc(v0, v1) :- tc(v0, v2) & edge(v2, v1)', 3, true, 1),
(2, 'tc(X, Y) :- edge(Y, Z)', 'tc(v0, v1) :- edge(v1, v2)', 3, false, 1), (3, 'tc(X, X) :- edge(X, X)', 'tc(v0, v0) :- edge(v0, v0)', 1, true, 1),
(4, 'tc(X, Y) :- edge(X, Y) & no(tc(Y, Z))', 'tc(v0, v1) :- edge(v0, v1) & no(tc(v1, v2))', 3, false, 1), (5, 'tc(X, Y) :- edge(X, Y) | edge(Y, X)', 'tc(v0, v1) :- edge(v0, v1) | edge(v1, v0)', 2, true, 2)) t(number, text, normal, bindings, legal, alternatives)""")
def dl_rule_forms(spark, sf_dir):
    """Rules as text, by first use of their variables, with how many those are, and whether each is bound."""
    rows = [(k, repr(r), repr(r.normalized()), r.bindings, not r.problems(), len(r.alternatives())) for k, r in enumerate(_rules(spark))]
    return literal(spark, rows, "number int, text string, normal string, bindings int, legal boolean, alternatives int")


@query("""SELECT * FROM (VALUES (0, 'edge(src, dst)'), (1, 'tc(src, dst)'), (2, 'stratum 0: tc (recursive)'), (3, '  tc(X, Y) :- edge(X, Y)'), (4, '  tc(X, Z) :- tc(X, Y) & edge(Y, Z)')) t(line, text)""")
def dl_text(spark, sf_dir):
    """A program's declarations, strata and rules as text."""
    p, *_ = _hier(spark, sf_dir)
    return literal(spark, list(enumerate(p.explain().split("\n"))), "line int, text string")


@query("SELECT DISTINCT c_custkey AS X FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'")
def dl_substitute(spark, sf_dir):
    """A literal whose variables were replaced by values."""
    p, _, customer, *_ = _places(spark, sf_dir)
    return p.query(customer(X, Y, Z).substitute({Y: 3, Z: "MACHINERY"}))


# Sequences


def _types(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return e.select(F.col("user_id").alias("seq_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("pos"), F.col("event_type").alias("sym"))


_SEQ = "WITH s AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS sym FROM events), n AS (SELECT seq_id, count(*) AS n FROM s GROUP BY 1)"
_PROBES = "(SELECT unnest([-1, 0, 1, 2, 5, 50, 100000]) AS i)"


def _probe(spark, df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1, 2, 5, 50, 100000)))))


@query(f"{_SEQ} SELECT n.seq_id, 'error' AS sym, i, CASE WHEN i <= 0 THEN i ELSE (SELECT count(*) FROM s WHERE s.seq_id = n.seq_id AND sym = 'error' AND pos < i) + greatest(0, i - n) END AS rank FROM n, {_PROBES}")
def seq_rank(spark, sf_dir):
    s = _types(spark, sf_dir)
    return long_sequences.rank_rows(s, _probe(spark, s.select("seq_id").distinct().withColumn("sym", F.lit("error")), "i"))


@query(f"{_SEQ} SELECT n.seq_id, 'error' AS sym, CAST(1 AS BIGINT) AS i, n AS j, (SELECT count(*) FROM s WHERE s.seq_id = n.seq_id AND sym = 'error' AND pos >= 1 AND pos < n) AS n FROM n")
def seq_delta_rank(spark, sf_dir):
    s = _types(spark, sf_dir)
    ranges = s.groupBy("seq_id").agg(F.count("*").alias("j")).select("seq_id", F.lit("error").alias("sym"), F.lit(1).cast("long").alias("i"), "j")
    return long_sequences.delta_rank_rows(s, ranges)


@query(f"""{_SEQ}, o AS (SELECT seq_id, pos, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS k FROM s WHERE sym = 'error'), t AS (SELECT seq_id, count(*) AS t FROM o GROUP BY 1)
SELECT n.seq_id, 'error' AS sym, i AS k, CASE WHEN i <= 0 THEN i WHEN i > coalesce(t, 0) THEN n + i - coalesce(t, 0) ELSE (SELECT pos + 1 FROM o WHERE o.seq_id = n.seq_id AND o.k = i) END AS pos
FROM n CROSS JOIN {_PROBES} LEFT JOIN t ON t.seq_id = n.seq_id""")
def seq_select(spark, sf_dir):
    s = _types(spark, sf_dir)
    return long_sequences.select_rows(s, _probe(spark, s.select("seq_id").distinct().withColumn("sym", F.lit("error")), "k"))


@query(f"""{_SEQ}, a AS (SELECT seq_id, list(sym ORDER BY pos) AS xs FROM s GROUP BY 1)
SELECT seq_id, len(xs) AS size, len(list_filter(xs[1:least(5, len(xs))], lambda v: v = 'click')) + greatest(0, 5 - len(xs)) AS rank5,
  CASE WHEN 3 > len(list_filter(xs, lambda v: v = 'click')) THEN len(xs) + 3 - len(list_filter(xs, lambda v: v = 'click')) ELSE list_filter(list_transform(xs, lambda v, i: CASE WHEN v = 'click' THEN i END), lambda p: p IS NOT NULL)[3] END AS select3 FROM a""")
def seq_arrays(spark, sf_dir):
    """Rank and select on array columns."""
    s = _types(spark, sf_dir).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sym")))["sym"].alias("xs"))
    xs, x = F.col("xs"), F.lit("click")
    return s.select("seq_id", sequences.size(xs).cast("long").alias("size"), sequences.rank(x, xs, F.lit(5)).alias("rank5"), sequences.select(x, xs, F.lit(3)).alias("select3"))


# Bit vectors: position event_id, bit value > 50, one vector


def _bits(spark, sf_dir):
    return parquet(spark, sf_dir, "events").select(F.lit("v").alias("bv_id"), F.col("event_id").alias("pos"), (F.col("value") > 50).alias("bit"))


def _vector(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    return bitvectors.pack_rows(rows), rows.groupBy("bv_id").agg((F.max("pos") + 1).alias("n_bits"))


_WORDS = "SELECT 'v' AS bv_id, event_id // 64 AS word_idx, CAST(bit_or(CASE WHEN value > 50 THEN 1::HUGEINT << (event_id % 64)::INT ELSE 0 END) AS HUGEINT) AS u FROM events GROUP BY 2"
_SIGNED = "CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT)"
_BITS = "b AS (SELECT event_id AS pos, value > 50 AS bit FROM events), n AS (SELECT max(event_id) + 1 AS n, count(*) FILTER (WHERE value > 50) AS ones FROM events)"
_AT = "(SELECT unnest([-5, 0, 1, 63, 64, 65, 100, 2047, 2048, 2049, 5000, 9999, 10000, 20000000]) AS pos)"


def _points(spark, name="pos"):
    return literal(spark, [("v", i) for i in (-5, 0, 1, 63, 64, 65, 100, 2047, 2048, 2049, 5000, 9999, 10000, 20000000)], f"bv_id string, {name} bigint")


@query(f"SELECT bv_id, word_idx, {_SIGNED} AS word FROM ({_WORDS})")
def bit_pack(spark, sf_dir):
    return _vector(spark, sf_dir)[0]


@query("SELECT 'v' AS bv_id, event_id AS pos, value > 50 AS bit FROM events")
def bit_unpack(spark, sf_dir):
    return bitvectors.unpack_rows(*_vector(spark, sf_dir))


@query(f"WITH {_BITS} SELECT 'v' AS bv_id, p.pos, coalesce(bit, false) AS bit FROM {_AT} p LEFT JOIN b ON b.pos = p.pos")
def bit_index(spark, sf_dir):
    return bitvectors.index_rows(*_vector(spark, sf_dir), _points(spark))


@query(f"""WITH e AS (SELECT event_id, CASE WHEN value > 75 THEN event_id % 2 = 0 ELSE value > 50 END AS bit FROM events),
w AS (SELECT event_id // 64 AS word_idx, bit_or(CASE WHEN bit THEN 1::HUGEINT << (event_id % 64)::INT ELSE 0 END) AS u FROM e GROUP BY 1) SELECT 'v' AS bv_id, word_idx, {_SIGNED} AS word FROM w""")
def bit_update(spark, sf_dir):
    """Bits of large values set to whether their position is even; earlier changes of the same positions lose."""
    w, n = _vector(spark, sf_dir)
    large = parquet(spark, sf_dir, "events").where("value > 75").select(F.lit("v").alias("bv_id"), F.col("event_id").alias("pos"))
    even = F.col("pos") % 2 == 0
    changes = large.select("*", even.alias("bit"), F.lit(2).alias("ord")).union(large.select("*", (~even).alias("bit"), F.lit(1).alias("ord")))
    return bitvectors.update_rows(w, n, changes)


@query(f"SELECT bv_id, word_idx, {_SIGNED} AS word FROM (SELECT bv_id, word_idx, CASE WHEN word_idx = 15 THEN u & ((1::HUGEINT << 40) - 1) ELSE u END AS u FROM ({_WORDS}) WHERE word_idx < 16)")
def bit_take(spark, sf_dir):
    w, n = _vector(spark, sf_dir)
    return bitvectors.take_rows(w, n, 1000)[0]


@query("SELECT 'v' AS bv_id, bool_and((value > 50) = (value > 50.5)) AS equal FROM events")
def bit_eq(spark, sf_dir):
    w, n = _vector(spark, sf_dir)
    other = bitvectors.pack_rows(parquet(spark, sf_dir, "events").select(F.lit("v").alias("bv_id"), F.col("event_id").alias("pos"), (F.col("value") > 50.5).alias("bit")))
    return bitvectors.equal_rows(w, other, n, n)


@query(f"""WITH w AS (SELECT word_idx // 32 AS chunk, sum(bit_count(CAST(u & 4294967295 AS BIGINT)) + bit_count(CAST(u >> 32 AS BIGINT))) AS ones FROM ({_WORDS}) GROUP BY 1)
SELECT 'v' AS bv_id, chunk, CAST(coalesce(sum(ones) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ones_before, CAST(ones AS BIGINT) AS ones FROM w""")
def pop_build(spark, sf_dir):
    return bitvectors.directory(*_vector(spark, sf_dir)).select("bv_id", "chunk", "ones_before", "ones")


_POP_RANK = "WITH {bits} SELECT 'v' AS bv_id, p.pos, CASE WHEN p.pos <= 0 THEN p.pos ELSE (SELECT count(*) FROM b WHERE b.pos < p.pos AND {bit}) + greatest(0, p.pos - n.n) END AS rank FROM {at} p, n"


@query(_POP_RANK.format(bits=_BITS, bit="bit", at=_AT))
def pop_rank(spark, sf_dir):
    return bitvectors.rank_rows(bitvectors.directory(*_vector(spark, sf_dir)), _points(spark))


@query(_POP_RANK.format(bits=_BITS, bit="NOT bit", at=_AT))
def pop_rank_zeros(spark, sf_dir):
    return bitvectors.rank_rows(bitvectors.directory(*_vector(spark, sf_dir)), _points(spark), bit=False)


_POP_SELECT = """WITH {bits}, o AS (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM b WHERE {bit}), t AS (SELECT count(*) AS t FROM o)
SELECT 'v' AS bv_id, p.pos AS k, CASE WHEN p.pos <= 0 THEN p.pos WHEN p.pos > t THEN n.n + p.pos - t ELSE (SELECT o.pos + 1 FROM o WHERE o.k = p.pos) END AS pos FROM {at} p, n, t"""


@query(_POP_SELECT.format(bits=_BITS, bit="bit", at=_AT))
def pop_select(spark, sf_dir):
    return bitvectors.select_rows(bitvectors.directory(*_vector(spark, sf_dir)), _points(spark, "k"))


@query(_POP_SELECT.format(bits=_BITS, bit="NOT bit", at=_AT))
def pop_select_zeros(spark, sf_dir):
    return bitvectors.select_rows(bitvectors.directory(*_vector(spark, sf_dir)), _points(spark, "k"), bit=False)


_USER_BITS = "WITH a AS (SELECT user_id, list(value > 50 ORDER BY ts, event_id) AS xs FROM events GROUP BY 1)"


@query(f"""{_USER_BITS} SELECT user_id, len(xs) AS n_bits, coalesce(xs[3], false) AS bit2, len(xs[1:least(5, len(xs))]) AS taken, len(list_filter(xs, lambda b: b)) AS ones,
  len(list_filter(xs[1:least(70, len(xs))], lambda b: b)) + greatest(0, 70 - len(xs)) AS rank70,
  CASE WHEN len(list_filter(xs, lambda b: b)) < 2 THEN len(xs) + 2 - len(list_filter(xs, lambda b: b)) ELSE list_filter(list_transform(xs, lambda b, i: CASE WHEN b THEN i END), lambda p: p IS NOT NULL)[2] END AS select2, true AS same FROM a""")
def bit_columns(spark, sf_dir):
    """Bit vectors as columns: a vector for each user, through pack, index, take, rank, select and the byte form."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 50).alias("b"))))["b"]
    u = parquet(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("xs")).select("user_id", "xs", bitmaps.pack(F.col("xs")).alias("bm"))
    bm = F.col("bm")
    same = bitmaps.equal(bitmaps.deserialize(bitmaps.serialize(bm)), bm) & (bitmaps.unpack(bm) == F.col("xs")) & bitmaps.equal(bitmaps.read(bitmaps.show(bm)), bm)
    return u.select(
        "user_id", bitmaps.size(bm).alias("n_bits"), bitmaps.index(bm, F.lit(2)).alias("bit2"), bitmaps.size(bitmaps.take(bm, F.lit(5))).alias("taken"),
        bitmaps.rank(True, bm, bm["n_bits"]).alias("ones"), bitmaps.rank(True, bm, F.lit(70)).alias("rank70"), bitmaps.select(True, bm, F.lit(2)).alias("select2"), same.alias("same"),
    )


_INVERTED = "list_filter(xs, lambda b: NOT b)"


@query(f"""{_USER_BITS} SELECT user_id, (len(xs) + 63) // 64 AS n_words, (len(xs) + 63) // 64 * 8 AS n_bytes, false AS none, true AS empty, len(xs) > 20 AS has20, len({_INVERTED}) AS zeros, least(len(xs), 40) AS cut,
  CASE WHEN len(list_filter(xs[1:50], lambda b: b)) = 0 THEN 0 ELSE list_sum(list_transform(xs[1:50], lambda b, i: CASE WHEN b THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END))::BIGINT END AS low50,
  CASE WHEN len(list_filter(xs, lambda b: b)) = len(xs) THEN 0 ELSE -1 END AS order_ones, CASE WHEN len(xs) = 1 THEN 0 ELSE -1 END AS order_longer FROM a""")
def bit_columns_more(spark, sf_dir):
    """Words required, word fetch, emptiness, containment, a function of each bit, the first bits of given words, and the order of vectors."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 50).alias("b"))))["b"]
    u = parquet(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("xs")).select("user_id", "xs", bitmaps.pack(F.col("xs")).alias("bm"))
    bm, n = F.col("bm"), F.col("bm")["n_bits"]
    inverted, ones = bitmaps.each(bm, lambda b: ~b), bitmaps.each(bm, lambda b: F.lit(True))
    longer = bitmaps.pack(F.concat(F.slice("xs", 2, 1), F.col("xs")))
    first50 = bitmaps.word(bitmaps.take(bm, F.lit(50)), F.lit(0))
    return u.select(
        "user_id", bitmaps.words_required(n).cast("long").alias("n_words"), bitmaps.bytes_required(n).cast("long").alias("n_bytes"), bitmaps.is_null(bm).alias("none"), bitmaps.is_null(bitmaps.empty()).alias("empty"),
        bitmaps.contains(bm, F.lit(20)).alias("has20"), bitmaps.rank(True, inverted, n).alias("zeros"), bitmaps.size(bitmaps.make(F.lit(40), F.slice(bm["words"], 1, 1))).alias("_cut"), first50.alias("low50"),
        bitmaps.compare(bm, ones).alias("order_ones"), bitmaps.compare(bm, longer).alias("order_longer"), n.alias("_n"),
    ).withColumn("cut", F.least("_cut", "_n")).drop("_cut", "_n")


@query()
def bit_file(spark, sf_dir):
    """A file as a bit vector: 8 bits a byte; the name of the file is all that SQL has not."""
    return bit_words(spark, f"{sf_dir}/region.parquet").select("n_bits", "word_idx", "word")


# Words: keys spread over 64 bits

_WORD = f"WITH k AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem), w AS (SELECT DISTINCT (l_orderkey::HUGEINT * 1099511627776 + l_partkey::HUGEINT * 2097152 + l_suppkey::HUGEINT * 128 + l_linenumber::HUGEINT) % 18446744073709551616 AS u FROM k)"


def _word_rows(spark, sf_dir) -> DataFrame:
    li = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    u = F.expr("pmod(cast(l_orderkey as decimal(38,0)) * 1099511627776 + l_partkey * 2097152 + l_suppkey * 128 + l_linenumber, 18446744073709551616BD)")
    return li.select(F.when(u >= F.expr("9223372036854775808BD"), u - F.expr("18446744073709551616BD")).otherwise(u).cast("long").alias("x")).distinct()


def _byte(i: int, u: str = "u") -> str:
    return f"(({u} >> {8 * i}) & 255)"


def _ones(v: str) -> str:
    return f"(bit_count(CAST({v} & 4294967295 AS BIGINT)) + bit_count(CAST({v} >> 32 AS BIGINT)))"


def _sum_bytes(f) -> str:
    return "(" + " + ".join(f"({f(i)})::HUGEINT * {256**i}" for i in range(8)) + ")"


def _word_sql(value: str, signed: bool = True) -> str:
    out = _SIGNED.replace("u ", "r ").replace("ELSE u ", "ELSE r ").replace("THEN u ", "THEN r ").replace("(CASE WHEN u", "(CASE WHEN r") if signed else "CAST(r AS BIGINT)"
    return f"{_WORD} SELECT {_SIGNED} AS x, {out} AS y FROM (SELECT u, {value} AS r FROM w)"


def _word_query(name: str, value: str, f, signed: bool = True) -> None:
    def run(spark, sf_dir):
        return _word_rows(spark, sf_dir).select("x", f(F.col("x")).cast("long").alias("y"))

    run.__name__ = name
    query(_word_sql(value, signed))(run)


_Y = "((u * 3 + 81985529216486895) % 18446744073709551616)"  # another word to compare with


def _other(x: Column) -> Column:
    d = F.pmod(F.when(x < 0, x.cast("decimal(38,0)") + F.expr("18446744073709551616BD")).otherwise(x.cast("decimal(38,0)")) * 3 + F.expr("81985529216486895BD"), F.expr("18446744073709551616BD"))
    return F.when(d >= F.expr("9223372036854775808BD"), d - F.expr("18446744073709551616BD")).otherwise(d).cast("long")


def _sb(i: int, u: str) -> str:
    return f"(CASE WHEN {_byte(i, u)} >= 128 THEN {_byte(i, u)} - 256 ELSE {_byte(i, u)} END)"


_word_query("word_reverse_bits", "(" + " + ".join(f"((u >> {i}) & 1) * {2 ** (63 - i)}::HUGEINT" for i in range(64)) + ")", words.reverse_bits)
_word_query("word_reverse_bytes", _sum_bytes(lambda i: _byte(7 - i)), words.reverse_bytes)
_word_query("word_byte_sum", "(" + " + ".join(_byte(i) for i in range(8)) + ") % 256", words.byte_sum, False)
_word_query("word_byte_counts", _sum_bytes(lambda i: f"bit_count(CAST({_byte(i)} AS BIGINT))"), words.byte_counts)
_word_query("word_leq8", _sum_bytes(lambda i: f"CASE WHEN {_sb(i, 'u')} <= {_sb(i, _Y)} THEN 1 ELSE 0 END"), lambda x: words.leq8(x, _other(x)))
_word_query("word_uleq8", _sum_bytes(lambda i: f"CASE WHEN {_byte(i)} <= {_byte(i, _Y)} THEN 1 ELSE 0 END"), lambda x: words.uleq8(x, _other(x)))
_word_query("word_nonzero8", _sum_bytes(lambda i: f"CASE WHEN {_byte(i)} <> 0 THEN 1 ELSE 0 END"), words.nonzero8)
_word_query("word_select", "list_filter(range(64), lambda i: ((u >> i::INT) & 1) = 1)[4]", lambda x: words.select_word64(x, 3), False)
_word_query("word_lsb", "list_filter(range(64), lambda i: ((u >> i::INT) & 1) = 1)[1]", words.lsb, False)
_word_query("word_msb", "list_filter(range(64), lambda i: ((u >> i::INT) & 1) = 1)[-1]", words.msb, False)
_word_query("word_popcount", _ones("u"), words.pop_count, False)
_word_query("word_rank", "len(list_filter(range(20), lambda i: ((u >> i::INT) & 1) = 1))", lambda x: words.rank_word(True, x, 20), False)
_word_query("word_rank_zeros", "len(list_filter(range(64), lambda i: ((u >> i::INT) & 1) = 0)) + 6", lambda x: words.rank_word(False, x, 70), False)
_word_query("word_select_zeros", "list_filter(range(64), lambda i: ((u >> i::INT) & 1) = 0)[10] + 1", lambda x: words.select_word(False, x, 10), False)


# Statistics


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_STAT = "max({0}) AS max, min({0}) AS min, round(sum({0}), 4) AS sum, count({0}) AS count, round(avg({0}), 4) AS mean, round(coalesce(var_samp({0}), 0) * (count({0}) - 1), {1}) AS sos"


@query(f"SELECT l_returnflag, l_linestatus, {_STAT.format('l_quantity', 4)} FROM lineitem GROUP BY 1, 2")
def stat_summary(spark, sf_dir):
    return _rounded(stats.summarize(parquet(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"))


@query(f"SELECT l_linestatus, {_STAT.format('l_quantity', 2)} FROM lineitem GROUP BY 1")
def stat_merge(spark, sf_dir):
    """Summaries by two keys, merged to one."""
    parts = stats.summarize(parquet(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return _rounded(stats.merge_rows(parts, ["l_linestatus"])).withColumn("sos", F.round("sos", 2))


@query("""WITH s AS (SELECT user_id, max(value) AS mx, min(value) AS mn, avg(value) AS mean, count(value) AS n, sum(value) AS sm, coalesce(var_samp(value), 0) AS var FROM events GROUP BY 1)
SELECT user_id, stat, round(value, 4) AS value FROM (SELECT user_id, unnest([{'stat': 'max', 'value': mx}, {'stat': 'min', 'value': mn}, {'stat': 'mean', 'value': mean}, {'stat': 'count', 'value': n::DOUBLE}, {'stat': 'sum', 'value': sm}, {'stat': 'stdDev', 'value': sqrt(var)}, {'stat': 'var', 'value': var}], recursive := true) FROM s)""")
def stat_expand(spark, sf_dir):
    return _rounded(stats.expand(stats.summarize(parquet(spark, sf_dir, "events"), ["user_id"], "value"), ["user_id"]))


@query(f"SELECT event_type, {_STAT.format('value', 2)} FROM events GROUP BY 1")
def stat_json(spark, sf_dir):
    """Summaries through their JSON form and back."""
    s = stats.summarize(parquet(spark, sf_dir, "events"), ["event_type"], "value")
    back = s.select("event_type", stats.from_json(stats.to_json(stats.struct_of())).alias("s")).select("event_type", "s.*")
    return _rounded(back).withColumn("sos", F.round("sos", 2))


def _judged(spark, sf_dir):
    s = stats.summarize(parquet(spark, sf_dir, "events"), ["event_type"], "value")
    e = parquet(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return e.join(s, "event_type").withColumn("s", stats.struct_of())  # a summary a type: a small side, broadcast by its size


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, value FROM events JOIN s USING (event_type) WHERE n >= 10 AND (value > m + 3 * sd OR value < m - 3 * sd)""")
def stat_outliers(spark, sf_dir):
    return _judged(spark, sf_dir).where(stats.is_extreme(10, F.col("s"), F.col("value"))).select("event_id", "value")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN n >= 10 AND (value > m + 3 * sd OR value < m - 3 * sd) THEN m ELSE value END, 4) AS value FROM events JOIN s USING (event_type)""")
def stat_trim(spark, sf_dir):
    return _rounded(_judged(spark, sf_dir).select("event_id", stats.trim(10, F.col("s"), F.col("value")).alias("value")))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, x AS mx, x AS mn, x AS sm, CAST(1 AS BIGINT) AS n, x AS mean, CAST(0 AS DOUBLE) AS sos FROM e WHERE i = 1
UNION ALL SELECT user_id, i, greatest(mx, y), least(mn, y), sm + y, n + 1, mean + (y - mean) / (n + 1), sos + (y - mean) * (y - (mean + (y - mean) / (n + 1))) FROM (
  SELECT f.user_id, e.i, mx, mn, sm, n, mean, sos, CASE WHEN n >= 3 AND (x > mean + 3 * sqrt(CASE WHEN n < 2 THEN 0 ELSE sos / (n - 1) END) OR x < mean - 3 * sqrt(CASE WHEN n < 2 THEN 0 ELSE sos / (n - 1) END)) THEN mean ELSE x END AS y
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, round(mx, 4) AS max, round(mn, 4) AS min, round(sm, 4) AS sum, n AS count, round(mean, 4) AS mean, round(sos, 1) AS sos FROM f QUALIFY i = max(i) OVER (PARTITION BY user_id)""")
def stat_online_trim(spark, sf_dir):
    s = stats.online_trim_rows(parquet(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 3)
    return _rounded(s).withColumn("sos", F.round("sos", 1))


@query("SELECT user_id, max(value) AS max, min(value) AS min, round(sum(value), 4) AS sum, count(value) AS count, round(avg(value) + 1e-8, 4) AS mean, round(coalesce(var_samp(value), 0) * (count(value) - 1) + 1e-4, 2) AS sos FROM events GROUP BY 1")
def stat_list(spark, sf_dir):
    """Summaries of lists, merged with that of nothing on either side. Means of cents may end in a 5: what is added keeps them off the edge of rounding."""
    nothing = F.lit(None).cast(stats.TYPE)
    xs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))["value"]
    s = parquet(spark, sf_dir, "events").groupBy("user_id").agg(stats.merge(nothing, stats.merge(stats.of_array(xs), nothing)).alias("s"))
    return s.select("user_id", "s.max", "s.min", F.round("s.sum", 4).alias("sum"), "s.count", F.round(F.col("s.mean") + 1e-8, 4).alias("mean"), F.round(F.col("s.sos") + 1e-4, 2).alias("sos"))


@query(f"SELECT l_returnflag, l_linestatus, {_STAT.format('l_quantity', 4)} FROM lineitem GROUP BY 1, 2")
def stat_storage(spark, sf_dir):
    """Summaries through a stored table."""
    return _rounded(materialize(stats.summarize(parquet(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), "summaries"))


@query(SQL["stat_online_trim"])
def stat_stream(spark, sf_dir):
    """Running trimmed summaries over a stream of the events, as they are after its end."""
    schema = parquet(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, at = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    trimmed_summaries(stream, "user_id", "ts", "value", 3).writeStream.outputMode("update").option("checkpointLocation", at).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{out}/*").groupBy("user_id").agg(F.max_by(F.struct("max", "min", "sum", "count", "mean", "sos"), "batch").alias("s"))
    return _rounded(found.select("user_id", "s.*")).withColumn("sos", F.round("sos", 1))


# Clustering


@query("SELECT p_partkey, " + " + ".join([f"((p_size::BIGINT >> {5 - j}) & 1) * {2 ** (17 - 2 * j)}" for j in range(6)] + [f"((p_partkey >> {11 - j}) & 1) * {2 ** (16 - 2 * j if j < 6 else 11 - j)}" for j in range(12)]) + " AS z FROM part")
def zorder_key(spark, sf_dir):
    z = zorder.zkey([zorder.Key("p_size", 6), zorder.Key("p_partkey", 12)])
    return zorder.cluster(parquet(spark, sf_dir, "part").select("p_partkey", "p_size"), [zorder.Key("p_size", 6), zorder.Key("p_partkey", 12)]).select("p_partkey", z.alias("z"))


_Z = SQL["zorder_key"].split("SELECT p_partkey, ")[1].split(" AS z FROM")[0]


@query(f"SELECT p_partkey, {_Z} AS z FROM part ORDER BY z, p_partkey LIMIT 25")
def zorder_top(spark, sf_dir):
    """The 25 parts that come first along the curve."""
    z = zorder.zkey([zorder.Key("p_size", 6), zorder.Key("p_partkey", 12)])
    return zorder.top_k(parquet(spark, sf_dir, "part").select("p_partkey", z.alias("z")), ["z", "p_partkey"], 25)


@query("""SELECT place, col, b AS bit FROM (VALUES (0, 'a', 2), (1, 'b', 3), (2, 'a', 1), (3, 'b', 2), (4, 'a', 0), (5, 'b', 1), (6, 'b', 0)) t(place, col, b)""")
def zorder_schedule(spark, sf_dir):
    """The order of two keys' bits: the same, whatever third key stands between them."""
    a, b, c = zorder.Key("a", 3), zorder.Key("b", 4), zorder.Key("c", 5, priority=1, stride=2)
    with_third = [(k, bit) for k, bit in zorder.schedule([a, b, c]) if k < 2]
    assert with_third == zorder.schedule([a, b])
    return literal(spark, [(i, "ab"[k], bit) for i, (k, bit) in enumerate(with_third)], "place int, col string, bit int")


@query("SELECT n_nationkey * 2 AS n_nationkey, n_regionkey * 2 AS n_regionkey, coalesce(n_nationkey, 0) - (coalesce(n_regionkey, 0) - 7) AS folded FROM nation")
def row_columns(spark, sf_dir):
    """Functions over all columns of a row: traversed, mapped, and folded from the right."""
    n = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    folded = zorder.fold_columns(n, lambda c, rest: c - rest, F.lit(7))
    filled = zorder.traverse_columns(n.withColumn("folded", folded), lambda name, c: F.coalesce(c, F.lit(0)))
    return zorder.map_columns(filled, lambda c: c * 2).withColumn("folded", (F.col("folded") / 2).cast("int"))


# Wavelets: parts by size, 6 bits

_HAAR = """t AS (SELECT p_size::BIGINT AS k, count(*) AS v FROM part WHERE p_size BETWEEN 0 AND 63 GROUP BY 1),
c AS (SELECT l AS level, k // (1 << l) AS block, CAST(sum(CASE WHEN l > 6 OR (k // (1 << (l - 1))) % 2 = 0 THEN v ELSE -v END) AS BIGINT) AS diff FROM t, (SELECT unnest(range(1, 8)) AS l) GROUP BY 1, 2 HAVING diff <> 0)"""


@query(f"WITH {_HAAR} SELECT * FROM c")
def haar_coefficients(spark, sf_dir):
    return wavelets.coefficients(parquet(spark, sf_dir, "part"), "p_size", 6)


@query(f"""WITH {_HAAR}, s AS (SELECT * FROM c WHERE level > 6 UNION ALL (SELECT * FROM c WHERE level <= 6 ORDER BY abs(diff) / sqrt(pow(2.0, level)) DESC, level, block LIMIT 10)),
r(lo, hi) AS (VALUES (0, 64), (0, 10), (7, 33), (40, 41)),
e AS (SELECT lo, hi, sum(diff * CASE WHEN level > 6 THEN hi - lo ELSE greatest(least(hi, block * w + w // 2) - greatest(lo, block * w), 0) - greatest(least(hi, block * w + w) - greatest(lo, block * w + w // 2), 0) END / w) AS estimate
  FROM r, (SELECT *, 1 << least(level, 6) AS w FROM s) GROUP BY 1, 2)
SELECT lo, hi, round(estimate, 3) AS estimate, (SELECT coalesce(sum(v), 0)::BIGINT FROM t WHERE k >= lo AND k < hi) AS actual FROM e""")
def haar_estimate(spark, sf_dir):
    """Sums over ranges from ten coefficients, beside the true ones."""
    part = parquet(spark, sf_dir, "part")
    sketch = wavelets.keep_largest(wavelets.coefficients(part, "p_size", 6), 10, 6)
    r = wavelets.estimate_ranges(sketch, literal(spark, [(0, 64), (0, 10), (7, 33), (40, 41)], "lo bigint, hi bigint"), 6)
    sizes = part.groupBy("p_size").agg(F.count("*").alias("n"))
    r = r.join(sizes, (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi")), "left").groupBy("lo", "hi", "estimate").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("actual"))
    return r.select("lo", "hi", F.round("estimate", 3).alias("estimate"), "actual")


@query(f"""WITH e AS ({SQL['haar_estimate']}) SELECT lo, hi, round(abs(actual - estimate), 2) AS e_abs, CASE WHEN actual <> 0 THEN round(abs(actual - estimate) / actual, 4) END AS e_rel,
  round(CASE WHEN actual = 0 THEN 2 * abs(actual - estimate) ELSE least(2 * abs(actual - estimate), 100 * abs(actual - estimate) / actual) END, 2) AS e_comb FROM e""")
def haar_errors(spark, sf_dir):
    """Absolute, relative and combined errors of the estimates."""
    e = haar_estimate(spark, sf_dir)
    x, y = F.col("estimate"), F.col("actual")
    return e.select("lo", "hi", F.round(wavelets.e_abs(x, y), 2).alias("e_abs"), F.round(wavelets.e_rel(x, y), 4).alias("e_rel"), F.round(wavelets.e_comb(2.0, 100.0, x, y), 2).alias("e_comb"))


@query("""WITH t AS (SELECT p_size::BIGINT AS k, max(p_retailprice) AS v FROM part WHERE p_size BETWEEN 0 AND 63 GROUP BY 1)
SELECT l AS level, k // (1 << l) AS block, max(v) AS max, round(max(v) FILTER (WHERE l > 0 AND (k // (1 << greatest(l - 1, 0))) % 2 = 1) - max(v) FILTER (WHERE l > 0 AND (k // (1 << greatest(l - 1, 0))) % 2 = 0), 4) AS delta
FROM t, (SELECT unnest(range(0, 7)) AS l) GROUP BY 1, 2""")
def haar_max(spark, sf_dir):
    return _rounded(wavelets.max_sketch(parquet(spark, sf_dir, "part"), "p_size", 6, F.col("p_retailprice")))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: everything each order, customer, supplier and nation belongs to."""
    return dl_tc_hier(spark, "/root/testdata/sf0.001")
