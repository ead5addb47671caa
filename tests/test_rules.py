"""Rules: the worked programs, legality, and closures against plain Python."""

from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lemmaflow.plans.program import BOOLEAN, MAX_MIN, Program, problem
from lemmaflow.plans.strata import components, stratify
from lemmaflow.plans.terms import Literal, Rule, Var, combine, expand, no, row, variables

X, Y, Z = variables("X Y Z")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def closure(spark, facts):
    p = Program(spark)
    edge, tc = p.table("edge", "src string, dst string"), p.table("tc", "src string, dst string")
    p.facts(edge, facts)
    p.rule(tc(X, Z), tc(X, Y) & edge(Y, Z))
    p.rule(tc(X, Y), edge(X, Y))
    return p, edge, tc


LOOP = [("A", "B"), ("B", "C"), ("B", "A")]


def test_closure_with_negation(spark):
    p, edge, tc = closure(spark, LOOP)
    assert rows(p.query(tc(X, Y))) == [tuple(x) for x in ("AA", "AB", "AC", "BA", "BB", "BC")]
    cyclic, acyclic, endpoint = (p.table(n, "x string") for n in ("cyclic", "acyclic", "endpoint"))
    p.rule(cyclic(X), tc(X, X))
    p.rule(acyclic(X), (edge(X, Y) | edge(Y, X)) & no(cyclic(X)))
    p.rule(endpoint(X), acyclic(X))
    assert rows(p.query(cyclic(X))) == [("A",), ("B",)]
    assert rows(p.query(endpoint(X))) == [("C",)]
    assert rows(p.query(row(tc("A", X)) & no(edge(X, "C")))) == [("A", "A"), ("A", "C")]
    assert p.query(row(tc("A", X))).columns == ["src", "dst"]


def test_bound_goal_seeds_the_recursion(spark):
    p, _, tc = closure(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("P", "Q"), ("Q", "R"), ("R", "S"), ("S", "T")])
    assert rows(p.query(tc("A", X))) == [("B",), ("C",), ("D",)]
    assert p.rounds["tc"] == 3  # the longer path from P is never followed
    assert rows(p.query(tc(X, "D"))) == [("A",), ("B",), ("C",)]


def test_bound_goal_of_a_right_linear_rule(spark):
    p = Program(spark)
    edge, tc = p.table("edge", "src string, dst string"), p.table("tc", "src string, dst string")
    p.facts(edge, [("A", "B"), ("B", "C"), ("C", "A"), ("P", "Q"), ("Q", "R"), ("R", "S"), ("S", "T"), ("T", "U")])
    p.fact(tc("C", "extra"))
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), edge(X, Y) & tc(Y, Z))
    assert rows(p.query(tc("A", X))) == [("A",), ("B",), ("C",), ("extra",)]
    assert p.rounds["tc"] <= 4  # P's path of five edges is not asked for
    assert rows(p.query(tc(X, "extra"))) == [("A",), ("B",), ("C",)] and rows(p.query(tc("U", X))) == []


def test_bound_goal_with_values(spark):
    p = Program(spark)
    edge, far = (p.table(n, "a string, b string, w int", value="w", merge="min") for n in ("edge", "far"))
    p.facts(edge, [("a", "b", 1), ("b", "c", 1), ("a", "c", 5), ("c", "a", 1), ("x", "y", 1)])
    p.rule(far(X, Y), edge(X, Y))
    p.rule(far(X, Z), edge(X, Y) + far(Y, Z))
    assert rows(p.query(row(far("a", X)))) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2)]


def test_toy_graph(spark):
    p, _, tc = closure(spark, [("A", "B"), ("B", "C"), ("B", "A"), ("C", "D"), ("D", "E"), ("E", "F")])
    assert [r[0] for r in rows(p.query(tc("A", X)))] == list("ABCDEF")


def test_roles(spark):
    p = Program(spark)
    ur, rr, rp, up = (p.table(n, "a string, b string") for n in ("userRole", "roleRole", "rolePermissions", "userPermissions"))
    p.fact(ur("Oz", "Admin"))
    p.fact(ur("Doug", "Lackey"))
    p.fact(rr("Admin", "Lackey"))
    p.facts(rp, [("Lackey", "ScrubToilets"), ("Admin", "MakeMoney")])
    p.fact(up("Oz", "DoubleSecretAccess"))
    p.rule(ur(X, Z), ur(X, Y) & rr(Y, Z))
    p.rule(rr(X, Z), rr(X, Y) & rr(Y, Z))
    p.rule(up(X, Z), ur(X, Y) & rp(Y, Z))
    assert rows(p.query(row(up(X, "ScrubToilets")))) == [("Doug", "ScrubToilets"), ("Oz", "ScrubToilets")]
    assert rows(p.query(up("Oz", X))) == [("DoubleSecretAccess",), ("MakeMoney",), ("ScrubToilets",)]


@pytest.mark.parametrize(("merge", "want"), [("min", {"AB": 2, "AC": 6, "AA": 8, "BC": 4, "BA": 6, "BB": 8}), ("first", {"AB": 2, "AC": 6, "AA": 8, "BC": 4, "BA": 6, "BB": 8})])
def test_values_add_along_paths(spark, merge, want):
    p = Program(spark)
    edge, tc = (p.table(n, "src string, dst string, w bigint", value="w", merge=merge) for n in ("edge", "tc"))
    p.fact(edge("A", "B"), 2)
    p.fact(edge("B", "C"), 4)
    p.fact(edge("B", "A"), 6)
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) + edge(Y, Z))
    assert {a + b: w for a, b, w in rows(p.query(row(tc(X, Y))))} == want


def test_other_semirings(spark):
    p = Program(spark)
    cap, wide = (p.table(n, "a string, b string, w int", value="w", merge=MAX_MIN.plus) for n in ("cap", "wide"))
    p.facts(cap, [("a", "b", 5), ("b", "c", 3), ("a", "c", 2), ("c", "a", 9)])
    p.rule(wide(X, Y), cap(X, Y))
    p.rule(wide(X, Z), combine(MAX_MIN.times, wide(X, Y), cap(Y, Z)))
    got = {a + b: w for a, b, w in rows(p.query(row(wide(X, Y))))}
    assert (got["ac"], got["bb"], got["ca"]) == (3, 3, 9)
    q = Program(spark)
    e, r = (q.table(n, "a string, b string, ok boolean", value="ok", merge=BOOLEAN.plus) for n in ("e", "r"))
    q.facts(e, [("a", "b", True), ("b", "c", False), ("b", "d", True)])
    q.rule(r(X, Y), e(X, Y))
    q.rule(r(X, Z), combine(BOOLEAN.times, r(X, Y), e(Y, Z)))
    assert {a + b: w for a, b, w in rows(q.query(row(r(X, Y))))} == {"ab": True, "bc": False, "bd": True, "ac": False, "ad": True}


def test_duplicate_facts_merge(spark):
    p = Program(spark)
    t = p.table(None, "k string, v int", value="v", merge="sum")
    p.facts(t, [("a", 1), ("a", 2), ("b", 5)])
    assert rows(p.query(row(t(X)))) == [("a", 3), ("b", 5)]
    s = p.table(None, "k string")
    p.facts(s, [("a",), ("a",)])
    assert s.name != t.name and rows(p.query(s(X))) == [("a",)]


def test_mutual_recursion_and_cross(spark):
    p = Program(spark)
    nxt, even, odd = p.table("next", "a int, b int"), p.table("even", "a int"), p.table("odd", "a int")
    p.facts(nxt, [(i, i + 1) for i in range(6)])
    p.fact(even(0))
    p.rule(odd(Y), even(X) & nxt(X, Y))
    p.rule(even(Y), odd(X) & nxt(X, Y))
    assert rows(p.query(even(X))) == [(0,), (2,), (4,), (6,)]
    assert len(rows(p.query(even(X) & odd(Y)))) == 12
    assert rows(p.query(even(X) & odd(3))) == rows(p.query(even(X)))
    assert rows(p.query(even(X) & no(odd(3)))) == []


def test_legality(spark):
    p, edge, tc = closure(spark, LOOP)
    with pytest.raises(ValueError, match="head variables"):
        p.rule(tc(X, Z), edge(X, Y))
    with pytest.raises(ValueError, match="negated"):
        p.rule(tc(X, X), edge(X, X) & no(edge(X, Z)))
    with pytest.raises(ValueError, match="columns"):
        edge(X)
    with pytest.raises(ValueError, match="no variables"):
        p.fact(edge("A", X))
    with pytest.raises(TypeError):
        edge(Var("N", "int"), X)
    n = p.table("n", "a int")
    with pytest.raises(TypeError):
        p.rule(n(X), edge(X, Y))
    with pytest.raises(ValueError, match="not declared"):
        p.rule(tc(X, Y), Literal("what", (X, Y)))
    p.rule(tc(X, Y), edge(X, Y) & no(tc(Y, X)))
    with pytest.raises(ValueError, match="recursive stratum"):
        p.query(tc(X, Y))
    q = Program(spark)
    t = q.table("t", "a int, v int", value="v", merge="sum")
    q.rule(t(X), t(X) + t(X))
    with pytest.raises(ValueError, match="need not end"):
        q.validate()


def test_normal_form_and_text():
    e, t = (lambda *a: Literal("e", a)), (lambda *a: Literal("t", a))
    a, b = Rule(t(X, Z), t(X, Y) & e(Y, Z)), Rule(t(Y, X), t(Y, Z) & e(Z, X))
    assert a.normalized() == b.normalized() and a.bindings == 3
    assert len(expand((e(X, Y) | e(Y, X)) & (t(X, X) | t(Y, Y)))) == 4
    assert repr(a) == "t(X, Z) :- t(X, Y) & e(Y, Z)" and repr(no(e(X, "C"))) == "no(e(X, 'C'))"
    assert e(X, Y).substitute({X: "A"}) == e("A", Y)


def test_strata():
    e, t = (lambda *a: Literal("e", a)), (lambda *a: Literal("t", a))
    got = stratify([Rule(t(X, Z), t(X, Y) & e(Y, Z)), Rule(t(X, Y), e(X, Y)), Rule(Literal("c", (X,)), t(X, X))])
    assert [(n, rec) for n, _, rec in got] == [(["t"], True), (["c"], False)]
    assert components("abcd", {"a": {"b"}, "b": {"a", "c"}, "c": {"d"}, "d": {"c"}}) == [["c", "d"], ["a", "b"]]


def test_problem_and_row_maker(spark):
    from pyspark.sql import functions as F

    p = Program(spark)
    edge = p.table("edge", "src string, dst string", make_row=lambda a, b: F.concat(a, F.lit("->"), b))
    tc = p.table("tc", "src string, dst string")
    out = problem(spark, {edge: [("A", "B"), ("B", "C")]}, [Rule(tc(X, Y), edge(X, Y)), Rule(tc(X, Z), tc(X, Y) & edge(Y, Z))], tc("A", X), [edge, tc])
    assert rows(out) == [("B",), ("C",)]
    p.facts(edge, [])
    assert [r.row for r in p.query(row(edge(X, "C"))).collect()] == ["B->C"]
    p.rule(tc(X, Y), edge(X, Y))
    assert "stratum 0: tc" in p.explain()


def test_empty_relations(spark):
    p, edge, tc = closure(spark, [])
    assert rows(p.query(tc(X, Y))) == [] and rows(p.query(edge("A", X))) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), max_size=8))
def test_closure_is_reachability(spark, edges):
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    p, _, tc = closure(spark, sorted(edges))
    assert set(rows(p.query(tc(X, Y)))) == want
    q = Program(spark)
    edge, tc = q.table("edge", "src string, dst string"), q.table("tc", "src string, dst string")
    q.facts(edge, sorted(edges))
    q.rule(tc(X, Y), edge(X, Y))
    q.rule(tc(X, Z), edge(X, Y) & tc(Y, Z))
    assert set(rows(q.query(tc("a", X)))) == {(b,) for a, b in want if a == "a"}


@pytest.mark.parametrize(("large", "few", "pieces"), [(0, 10**6, 1), (0, 0, 2)])
def test_fixpoint_of_large_relations(spark, large, few, pieces, monkeypatch):
    """However a round looks its new rows up, and however often the pieces are joined, the relation is the same."""
    import random

    from lemmaflow.plans import program as module

    monkeypatch.setattr(module, "LARGE", large)
    monkeypatch.setattr(module, "BROADCAST_ROWS", few)
    monkeypatch.setattr(module, "PIECES", pieces)
    rng = random.Random(3)
    edges = {(rng.randrange(9), rng.randrange(9)): rng.randrange(1, 9) for _ in range(10)} | {(k, k + 1): 1 for k in range(20, 23)}
    p = module.Program(spark)
    edge = p.table("edge", "a bigint, b bigint, w bigint", value="w", merge="min")
    p.facts(edge, [(a, b, w) for (a, b), w in edges.items()])
    far, tc = p.table("far", "a bigint, b bigint, w bigint", value="w", merge="min"), p.table("tc", "a bigint, b bigint")
    p.rule(far(X, Y), edge(X, Y))
    p.rule(far(X, Z), far(X, Y) + edge(Y, Z))
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) & tc(Y, Z))
    best = dict(edges)
    while True:
        more = dict(best)
        for (a, b), w in best.items():
            for (c, d), v in edges.items():
                if b == c and w + v < more.get((a, d), 10**9):
                    more[a, d] = w + v
        if more == best:
            break
        best = more
    assert {(r.a, r.b): r.w for r in p.evaluate(far).collect()} == best
    assert {tuple(r) for r in p.evaluate(tc).collect()} == set(best)
    assert {r.X for r in p.query(tc(20, X)).collect()} == {b for a, b in best if a == 20}


def test_bound_goal_of_two_recursive_literals(spark):
    """Magic sets hand what the left literal reaches to the right one; the rest of the graph is not derived."""
    p = Program(spark)
    edge, tc = p.table("edge", "a string, b string"), p.table("tc", "a string, b string")
    p.facts(edge, [("A", "B"), ("B", "C"), ("C", "A"), *((f"p{k}", f"p{k + 1}") for k in range(1000))])
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(X, Y) & tc(Y, Z))
    assert {r.X for r in p.query(tc("A", X)).collect()} == {"A", "B", "C"}
    assert p.rounds["tc"] <= 9  # the path of 1,000 edges takes more


def ring_and_tails(rng):
    """Edges with two cycles, a loop, tails and what lies between them."""
    return {(k, (k + 1) % 7) for k in range(7)} | {(k, 20 + (k - 19) % 5) for k in range(20, 25)} | {(3, 21), (40, 40), (50, 2), (24, 60), (60, 61)} | {(rng.randrange(70, 90), rng.randrange(70, 90)) for _ in range(25)}


@pytest.mark.parametrize(("large", "edges", "kind", "right"), [(0, 10**6, "bigint", False), (0, 10**6, "string", True), (0, 5, "bigint", False)])
def test_closure_by_components(spark, large, edges, kind, right, monkeypatch):
    """A closure that outgrows its edges is not written pair by pair; its pairs and their diagonal are the same."""
    import random

    from lemmaflow.plans import program as module

    monkeypatch.setattr(module, "LARGE", large)
    monkeypatch.setattr(module, "GROWTH", 1)
    monkeypatch.setattr(module, "MEMBERS", 3)
    monkeypatch.setattr(module.graphs, "EDGES", edges)
    used = []
    monkeypatch.setattr(module.Program, "_by_components", lambda self, *a, f=module.Program._by_components: used.append(a) or f(self, *a))
    cast = int if kind == "bigint" else str
    given = {(cast(a), cast(b)) for a, b in ring_and_tails(random.Random(5))}
    want = set(given)
    while more := {(a, d) for a, b in want for c, d in given if b == c} - want:
        want |= more
    p = Program(spark)
    edge, tc = (p.table(n, f"a {kind}, b {kind}") for n in ("edge", "tc"))
    cyclic = p.table("cyclic", f"a {kind}")
    p.facts(edge, sorted(given))
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), edge(X, Y) & tc(Y, Z) if right else tc(X, Y) & edge(Y, Z))
    p.rule(cyclic(X), tc(X, X))
    assert rows(p.query(tc(X, Y))) == sorted(want)
    assert rows(p.query(cyclic(X))) == sorted((a,) for a, b in want if a == b)
    assert rows(p.query(edge(X, Y) & no(tc(Y, X)))) == sorted((a, b) for a, b in given if (b, a) not in want)
    assert len(used) == (edges > 5)


def test_closure_of_other_starts_goes_on_by_rounds(spark, monkeypatch):
    from lemmaflow.plans import program as module

    monkeypatch.setattr(module, "LARGE", 0)
    monkeypatch.setattr(module, "GROWTH", 0)
    p = Program(spark)
    edge, tc = (p.table(n, "a int, b int") for n in ("edge", "tc"))
    p.facts(edge, [(1, 2), (2, 3), (3, 1)])
    p.facts(tc, [(9, 2), (9, 9)])
    p.rule(tc(X, Z), tc(X, Y) & edge(Y, Z))
    assert rows(p.query(tc(X, Y))) == [(9, 1), (9, 2), (9, 3), (9, 9)]


@pytest.mark.parametrize(("deep", "edges"), [(10, 10**6), (1, 10**6), (1, 5)])
def test_right_linear_goal_asks_for_nodes_only(spark, deep, edges, monkeypatch):
    """A bound goal keeps the asked-for nodes, not what each of them reaches; a long walk ends in one task if that fits."""
    from lemmaflow.plans import program as module

    monkeypatch.setattr(module, "DEEP", deep)
    monkeypatch.setattr(module.graphs, "EDGES", edges)
    kept = []
    monkeypatch.setattr(module, "scratch_path", lambda s, name, f=module.scratch_path: kept.append((name, f(s, name))) or kept[-1][1])
    p = Program(spark)
    edge, tc = p.table("edge", "src string, dst string"), p.table("tc", "src string, dst string")
    p.facts(edge, [*((f"n{k}", f"n{(k + 1) % 6}") for k in range(6)), ("n3", "end"), ("P", "Q"), ("Q", "n1")])
    p.facts(tc, [("n2", "extra"), ("P", "other")])
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), edge(X, Y) & tc(Y, Z))
    assert rows(p.query(tc("n0", X))) == [("end",), ("extra",), *((f"n{k}",) for k in range(6))]
    assert rows(p.query(tc("end", X))) == []
    assert {name for name, _ in kept if name.startswith("fix-")} == {"fix-_asked_tc"}
    assert rows(p.query(tc(X, "extra"))) == [("P",), ("Q",), *((f"n{k}",) for k in range(6))]


def test_goal_of_a_rule_that_says_more_of_the_free_column(spark):
    p = Program(spark)
    edge, good, tc = p.table("edge", "a int, b int"), p.table("good", "a int, b int"), p.table("tc", "a int, b int")
    p.facts(edge, [(1, 2), (2, 3), (2, 4), (3, 5)])
    p.facts(good, [(1, 3)])
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), edge(X, Y) & tc(Y, Z) & good(X, Z))
    assert rows(p.query(tc(1, X))) == [(2,), (3,)]


def test_bound_goal_of_a_doubled_rule_keeps_its_answers_only(spark, monkeypatch):
    """A rule that joins a closure with itself answers a bound goal from either end without the pairs of other nodes."""
    from lemmaflow.plans import program as module

    kept = []
    monkeypatch.setattr(module, "scratch_path", lambda s, name, f=module.scratch_path: kept.append((name, f(s, name))) or kept[-1][1])
    p = Program(spark)
    edge, tc = p.table("edge", "src int, dst int"), p.table("tc", "src int, dst int")
    p.facts(edge, [*((k, (k + 1) % 8) for k in range(8)), (3, 20), (30, 31), (31, 2)])
    p.facts(tc, [(20, 21), (21, 22)])
    p.rule(tc(X, Y), edge(X, Y))
    p.rule(tc(X, Z), tc(Y, Z) & tc(X, Y))
    assert rows(p.query(tc(30, X))) == [*((k,) for k in range(8)), (20,), (21,), (22,), (31,)]
    assert rows(p.query(tc(X, 22))) == [*((k,) for k in range(8)), (20,), (21,), (30,), (31,)]
    left = [path for name, path in kept if name == "fix-tc" and Path(path.removeprefix("file://")).exists()]
    assert sum(spark.read.parquet(path).count() for path in left) == 12 + 12
    assert rows(p.query(row(tc(30, 22)))) == [(30, 22)] and rows(p.query(tc(22, X))) == []
