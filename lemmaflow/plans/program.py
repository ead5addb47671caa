"""Programs: relations, facts, rules and queries, evaluated set-at-a-time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graphs
from ..sources.tables import literal as literal_rows
from ..sources.tables import discard, materialize, scratch_path, store
from .compile import apply_rule, join_body, scan
from .strata import stratify
from .terms import And, Body, Combine, Literal, Rule, Var, expand, row

#: Duplicate merges of a value: ``first`` keeps the value of the earliest fixpoint round, of equal rounds the least.
MERGES: dict[str, Callable[[str], Column]] = {"min": F.min, "max": F.max, "sum": F.sum, "first": F.min, "or": F.bool_or, "and": F.bool_and}


#: Rows of a relation from which a round looks only for its new rows' keys in it, rows up to which those are broadcast, and
#: pieces that a relation may be kept in before the later ones are joined.
LARGE, BROADCAST_ROWS, PIECES = 200_000, 500_000, 12
#: A closure of more rows than LARGE and than this many times its edges goes on by strongly connected components. Members of a
#: component that one group of its pairs starts from.
GROWTH, MEMBERS = 4, 2000
#: Rounds after which a walk from given nodes is finished by one task, if its edges fit one.
DEEP = 10


@dataclass(frozen=True)
class Semiring:
    """How values of alternative derivations merge (``plus``) and how a derivation's values combine (``times``)."""

    plus: str
    times: str


#: Closed semirings that recursion may use: shortest, widest and most reliable paths, and reachability.
MIN_PLUS, MAX_MIN, MAX_TIMES, BOOLEAN = Semiring("min", "+"), Semiring("max", "min"), Semiring("max", "*"), Semiring("or", "and")


@dataclass(eq=False)
class Relation:
    """A table of the program: key columns, at most one value column, the merge of equal keys' values."""

    name: str
    schema: T.StructType
    value: str | None = None
    merge: str | None = None
    make_row: Callable[..., Column] | None = None
    facts: list[tuple] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.schema if f.name != self.value]

    def __call__(self, *args: Any) -> Literal:
        if len(args) != len(self.keys):
            raise ValueError(f"{self.name} has {len(self.keys)} columns, not {len(args)}")
        for arg, name in zip(args, self.keys, strict=True):
            kind = self.schema[name].dataType.simpleString()
            if isinstance(arg, Var) and arg.kind and arg.kind != kind:
                raise TypeError(f"{self.name}.{name} is {kind}; variable {arg!r} stands for {arg.kind}")
        return Literal(self.name, args)

    def normal(self, df: DataFrame) -> DataFrame:
        """Set semantics: distinct keys, or one merged value a key."""
        if self.value is None:
            return df.select(*self.keys).distinct()
        return df.groupBy(*self.keys).agg(MERGES[self.merge](self.value).alias(self.value))

    def base(self, spark: SparkSession) -> DataFrame:
        """The facts, as given (not yet merged)."""
        frames = list(self.frames)
        if self.facts or not frames:
            frames.append(literal_rows(spark, self.facts, self.schema))
        out = frames[0].select(*self.schema.names)
        for f in frames[1:]:
            out = out.unionByName(f.select(*self.schema.names))
        return out


class Program:
    """Builds and evaluates a program.

    >>> edge = p.table("edge", "src string, dst string")
    >>> tc = p.table("tc", "src string, dst string")
    >>> p.facts(edge, [("A", "B"), ("B", "C"), ("B", "A")])
    >>> p.rule(tc(X, Z), tc(X, Y) & edge(Y, Z))
    >>> p.rule(tc(X, Y), edge(X, Y))
    >>> p.query(row(tc("A", X)) & no(edge(X, "C")))

    Results are DataFrames and compose with any others. Recursion runs semi-naive: every round joins only what is
    new, writes the new rows once to the shared folder and stops when there are none.
    """

    def __init__(self, spark: SparkSession, max_rounds: int = 1000):
        self.spark, self.max_rounds = spark, max_rounds
        self.relations: dict[str, Relation] = {}
        self.rules: list[Rule] = []
        self._known: dict[Any, DataFrame] = {}
        self._auto = itertools.count()
        self.rounds: dict[str, int] = {}
        self._condense = True

    # building
    def table(self, name: str | None, schema: str, value: str | None = None, merge: str | None = None, make_row: Callable[..., Column] | None = None, data: DataFrame | None = None) -> Relation:
        """Declares a relation; without a name it gets one of its own. ``value`` names its value column."""
        name = name or f"_t{next(self._auto)}"
        if name in self.relations:
            raise ValueError(f"{name} is declared already")
        fields = T.StructType.fromDDL(schema)
        if value is not None and (value not in fields.names or (merge or "first") not in MERGES):
            raise ValueError(f"{name}: no column {value} or no merge {merge}")
        self.relations[name] = Relation(name, fields, value, (merge or "first") if value else None, make_row)
        if data is not None:
            self.data(self.relations[name], data)
        return self.relations[name]

    def data(self, relation: Relation, df: DataFrame) -> None:
        """Adds a DataFrame's rows, columns by position, to the relation's facts. They are taken to be without nulls."""
        cols = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, relation.schema, strict=True)]
        relation.frames.append(df.select(*cols))
        self._known.clear()

    def facts(self, relation: Relation, rows: Iterable[tuple]) -> None:
        relation.facts.extend(tuple(r) for r in rows)
        self._known.clear()

    def fact(self, head: Literal, value: Any = None) -> None:
        """Asserts one ground tuple, with its value if the relation has one."""
        if head.own_vars():
            raise ValueError(f"{head!r}: a fact has no variables")
        r = self.relations[head.relation]
        if (r.value is None) != (value is None):
            raise ValueError(f"{head!r}: a value is given if and only if the relation has one")
        self.facts(r, [(*head.args, *(() if r.value is None else (value,)))])

    def rule(self, head: Literal | Rule, body: Body | None = None) -> Rule:
        """Adds ``head :- body``; illegal rules are refused at once."""
        r = head if isinstance(head, Rule) else Rule(head, body)
        bad = [*r.problems(), *(f"{r!r}: {x.relation} is not declared" for x in (r.head, *r.body.literals()) if x.relation not in self.relations)]
        if bad:
            raise ValueError("; ".join(bad))
        kinds: dict[Var, str] = {}
        for lit in (r.head, *r.body.literals()):
            rel = self.relations[lit.relation]
            for arg, name in zip(lit.args, rel.keys, strict=True):
                if isinstance(arg, Var):
                    kind = rel.schema[name].dataType.simpleString()
                    if kinds.setdefault(arg, kind) != kind:
                        raise TypeError(f"{r!r}: {arg!r} is {kinds[arg]} and {kind}")
        self.rules.append(r)
        self._known.clear()
        return r

    def validate(self) -> None:
        """Legality of every rule, and strata: negation inside a cycle and sums in recursion are refused."""
        for r in self.rules:
            if bad := r.problems():
                raise ValueError("; ".join(bad))
        for names, _, recursive in stratify(self.rules):
            for n in names:
                if recursive and self.relations[n].merge == "sum":
                    raise ValueError(f"{n}: a sum over a recursive relation need not end")

    def explain(self) -> str:
        """Declarations, strata and rules as text."""
        lines = [f"{r.name}({', '.join(r.keys)})" + (f" -> {r.value} by {r.merge}" if r.value else "") for r in self.relations.values()]
        for k, (names, rules, recursive) in enumerate(stratify(self.rules)):
            lines.append(f"stratum {k}: {', '.join(names)}" + " (recursive)" * recursive)
            lines += [f"  {r!r}" for r in rules]
        return "\n".join(lines)

    __repr__ = explain

    # evaluating
    def evaluate(self, relation: Relation | str, bound: dict[int, Any] | None = None) -> DataFrame:
        """The relation's rows: facts and whatever the rules derive.

        ``bound`` gives constants for key positions: only such rows are returned, and where every recursive rule
        hands these positions through unchanged, nothing else is derived on the way.
        """
        name = relation if isinstance(relation, str) else relation.name
        df = self._rows(name, bound or {})
        return df.distinct() if self.relations[name].value is None else df

    def _rows(self, name: str, bound: dict[int, Any]) -> DataFrame:
        """The relation's rows; facts of a relation without values and rules may repeat, as every head is distinct later."""
        self.validate()
        strata = stratify(self.rules)
        mine = next((s for s in strata if name in s[0]), None)
        rel = self.relations[name]
        seed: dict[int, Any] = {}
        if bound and mine and mine[2] and len(mine[0]) == 1:
            if (linear := self._linear(name, mine[1], bound)) is not None:
                return linear
            seed = {k: v for k, v in bound.items() if self._handed_through(name, mine[1], k)}
            if not seed and (asked := self._relevant(name, mine[1], bound)) is not None:
                return asked
        df = self._stratum(name, strata, tuple(sorted(seed.items())))
        for k, v in bound.items():
            df = df.where(F.col(rel.keys[k]) == F.lit(v))
        return df

    def _handed_through(self, name: str, rules: list[Rule], k: int) -> bool:
        for r in (a for rule in rules for a in rule.alternatives()):
            same = [x for x in r.body.literals() if x.relation == name]
            if same and (len(same) > 1 or same[0].negated or not isinstance(r.head.args[k], Var) or same[0].args[k] != r.head.args[k]):
                return False
        return True

    def _linear(self, name: str, rules: list[Rule], bound: dict[int, Any]) -> DataFrame | None:
        """The bound rows of a closure whose rule joins it with itself, by the rule with one recursive literal that hands the goal's constant through.

        Both say the same: paths of what the other rules and the facts give. None for other recursions.
        """
        rel = self.relations[name]
        flat = [a for r in rules for a in r.alternatives()]
        doubled = [r for r in flat if any(x.relation == name for x in r.body.literals())]
        if rel.value is not None or len(rel.keys) != 2:
            return None
        for r in doubled:
            (a, b), lits = r.head.args, [x for x in r.body.literals() if not x.negated and x.relation == name]
            ends = {x.args for x in lits}
            if len(lits) != 2 or len(list(r.body.literals())) != 2 or not any(m not in (a, b) and a != b and ends == {(a, m), (m, b)} and all(isinstance(v, Var) for v in (a, b, m)) for m in lits[0].args):
                return None
        key = (name, "linear", tuple(sorted(bound.items())))
        if key not in self._known:
            q = Program(self.spark, self.max_rounds)
            given = Relation(f"_given_{name}", rel.schema, facts=rel.facts, frames=rel.frames)
            q.relations = {k: v for k, v in self.relations.items() if k != name} | {given.name: given, name: Relation(name, rel.schema)}
            q.rules = [r for r in self.rules if r.head.relation != name]
            for r in flat:
                if r not in doubled:
                    q.rule(Rule(Literal(given.name, r.head.args), r.body, r.value))
            x, y, z = (Var(f"x{k}") for k in range(3))
            step = (Literal(name, (x, y)), Literal(given.name, (y, z))) if 0 in bound else (Literal(given.name, (x, y)), Literal(name, (y, z)))
            q.rule(Literal(name, (x, z)), Literal(given.name, (x, z)))
            q.rule(Literal(name, (x, z)), And(step))
            self._known[key] = q._rows(name, bound)
            self.rounds[name] = q.rounds.get(name, 0)
        return self._known[key]

    def _relevant(self, name: str, rules: list[Rule], bound: dict[int, Any]) -> DataFrame | None:
        """The bound rows of a recursion, by magic sets; None where the rules don't allow it.

        A relation of asked-for values is derived along: those of the goal, and those that a rule's other literals, and
        its recursive ones further left, hand on to a recursive one. Every rule then starts from it, so nothing is
        derived that no answer can need. Relations with values may have one recursive literal a rule. Where the recursive
        rules hand every position that is not bound through, what any asked-for value answers is an answer of the goal:
        then the recursion is over asked-for values alone, and the relation is looked up for them once.
        """
        key = (name, "asked", tuple(sorted(bound.items())))
        if key in self._known:
            return self._known[key]
        rel, at = self.relations[name], sorted(bound)
        q = Program(self.spark, self.max_rounds)
        q.relations = {k: v for k, v in self.relations.items() if k != name}
        q.rules = [r for r in self.rules if r.head.relation != name]
        asked = q.table(f"_asked_{name}", ", ".join(f"`{rel.keys[k]}` {rel.schema[rel.keys[k]].dataType.simpleString()}" for k in at))
        given = Relation(f"_given_{name}", rel.schema, rel.value, rel.merge, facts=rel.facts, frames=rel.frames)
        q.relations |= {given.name: given, name: Relation(name, rel.schema, rel.value, rel.merge)}
        q.fact(asked(*(bound[k] for k in at)))
        through = rel.value is None and self._only_asks(name, rules, at)

        def started(body: Body, args: tuple) -> Body:
            first = Literal(asked.name, tuple(args[k] for k in at))
            return Combine(body.op, (first, *body.items)) if isinstance(body, Combine) else And((first, *(body.items if isinstance(body, And) else (body,))))

        try:
            names = tuple(Var(f"x{k}") for k in range(len(rel.keys)))
            q.rule(Literal(name, names), started(Combine("+", (Literal(given.name, names),)) if rel.value else Literal(given.name, names), names))
            for r in (a for rule in rules for a in rule.alternatives()):
                same = [x for x in r.body.literals() if x.relation == name]
                if (rel.value and len(same) > 1) or any(x.negated for x in same) or (rel.value and not isinstance(r.body, Combine) and r.value is None and same):
                    return None
                if not (same and through):
                    q.rule(Rule(r.head, started(r.body, r.head.args), r.value))
                others = [x for x in r.body.literals() if x.relation != name]
                for i, x in enumerate(same):
                    if tuple(x.args[k] for k in at) != tuple(r.head.args[k] for k in at):
                        q.rule(Literal(asked.name, tuple(x.args[k] for k in at)), And((Literal(asked.name, tuple(r.head.args[k] for k in at)), *others, *same[:i])))
        except ValueError:  # a value that only the recursive literal binds
            return None
        df = q._rows(name, {})
        if through:
            df = df.select(*(F.lit(bound[k]).cast(rel.schema[c].dataType).alias(c) if k in bound else F.col(c) for k, c in enumerate(rel.keys))).distinct()
        for k, v in bound.items():
            df = df.where(F.col(rel.keys[k]) == F.lit(v))
        self._known[key] = df
        self.rounds[name] = q.rounds.get(name, q.rounds.get(asked.name, 0))
        return df

    def _only_asks(self, name: str, rules: list[Rule], at: list[int]) -> bool:
        """Whether every recursive rule hands the positions besides ``at`` through from one recursive literal, and says nothing else of them."""
        for r in (a for rule in rules for a in rule.alternatives()):
            same = [x for x in r.body.literals() if x.relation == name]
            if not same:
                continue
            head, tail = r.head.args, same[0].args
            free = [k for k in range(len(head)) if k not in at]
            elsewhere = {a for k in at for a in (head[k], tail[k])} | {v for x in r.body.literals() if x.relation != name for v in x.own_vars()}
            if len(same) > 1 or same[0].negated or any(not isinstance(head[k], Var) or head[k] != tail[k] or head[k] in elsewhere for k in free) or len({head[k] for k in free}) < len(free):
                return False
        return True

    def _stratum(self, name: str, strata: list, seed: tuple) -> DataFrame:
        key = (name, seed)
        if key in self._known:
            return self._known[key]
        mine = next((s for s in strata if name in s[0]), None)
        rel = self.relations[name]
        if mine is None:
            base = rel.base(self.spark)
            self._known[key] = base if rel.value is None else rel.normal(base)
            return self._known[key]
        names, rules, recursive = mine
        flat = [a for r in rules for a in r.alternatives()]

        def columns(n: str) -> list[str]:
            return self.relations[n].keys

        def value_of(n: str) -> str | None:
            return self.relations[n].value

        def lower(lit: Literal, _: int) -> DataFrame:
            return self._stratum(lit.relation, strata, ())

        def start(n: str) -> DataFrame:
            r = self.relations[n]
            parts = [r.base(self.spark)] if r.facts or r.frames else []
            parts += [apply_rule(x, lower, columns, value_of) for x in flat if x.head.relation == n and not any(y.relation in names for y in x.body.literals())]
            out = parts[0] if parts else r.base(self.spark)
            for p in parts[1:]:
                out = out.unionByName(p)
            for k, v in seed:
                out = out.where(F.col(r.keys[k]) == F.lit(v))
            return r.normal(out)

        if not recursive:
            self._known[key] = start(name)
            return self._known[key]
        for n, df in self._fixpoint(names, [r for r in flat if any(y.relation in names for y in r.body.literals())], start, lower, columns, value_of, dict(seed)).items():
            self._known[(n, seed)] = df
        return self._known[key]

    def _walk(self, names: Iterable[str], rules: list[Rule]) -> tuple[int, list[tuple[And, Var, Var]]] | None:
        """Whether the recursive rules do nothing but replace one column along edges, and hand the others through.

        Gives the column and, by rule, the body of the edges with their first and second node; None for other recursions.
        """
        name, *more = names
        rel = self.relations[name]
        if more or rel.value is not None:
            return None
        at, steps = set(), []
        for r in rules:
            lits = list(r.body.literals())
            same, others = [x for x in lits if x.relation == name], [x for x in lits if x.relation != name]
            if len(same) != 1 or same[0].negated or not isinstance(r.body, And):
                return None
            head, tail = r.head.args, same[0].args
            if not all(isinstance(a, Var) for a in (*head, *tail)) or len(set(head)) < len(head) or len(set(tail)) < len(tail):
                return None
            moved = [k for k in range(len(head)) if head[k] != tail[k]]
            bound = {v for x in others if not x.negated for v in x.own_vars()}
            if len(moved) != 1 or not {head[moved[0]], tail[moved[0]]} <= bound or {v for x in others for v in x.own_vars()} & {v for k, v in enumerate(head) if k != moved[0]}:
                return None
            at.add(moved[0])
            steps.append((And(tuple(others)), tail[moved[0]], head[moved[0]]))
        if len(at) != 1 or not graphs.fits(rel.schema[rel.keys[min(at)]].dataType):
            return None
        return min(at), steps

    def _by_components(self, name: str, edges: DataFrame, at: int) -> DataFrame:
        """All pairs of the edges' closure, from its strongly connected components.

        Kept are the components' members and the closure over components, in which there are no cycles; the pairs are
        made when they are read, so they take no room, and a reader's conditions on both nodes hold before.
        """
        spark, keys = self.spark, self.relations[name].keys
        kind = self.relations[name].schema[keys[at]].dataType.simpleString()
        members = materialize(graphs.strong_components(edges), f"members-{name}")
        a, b = (members.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
        between = edges.toDF("a", "b").join(a, "a").join(b, "b").where("ca <> cb").select("ca", "cb").distinct()
        p = Program(spark, self.max_rounds)
        p._condense = False
        edge = p.table("edge", "src bigint, dst bigint", data=materialize(between, f"between-{name}"))
        tc = p.table("tc", "src bigint, dst bigint")
        x, y, z = (Var(v) for v in "xyz")
        p.rule(tc(x, y), edge(x, y))
        p.rule(tc(x, z), tc(x, y) & edge(y, z))
        pairs = p._rows("tc", {}).unionByName(members.where("cyclic").select(F.col("component").alias("src"), F.col("component").alias("dst")).distinct())
        # the members of a large component are dealt over groups, each of which meets all that they reach
        parts = F.ceil(F.col("size") / F.lit(MEMBERS))
        groups = members.select(F.col("component").alias("src"), parts.alias("parts")).distinct()
        pairs = pairs.join(groups, "src").select("src", "dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        out = [None, None]
        out[1 - at], out[at] = F.col("a").cast(kind).alias(keys[1 - at]), F.col("b").cast(kind).alias(keys[at])
        left = members.select(F.col("node").alias("a"), F.col("component").alias("src"), F.pmod(F.xxhash64("node"), parts).alias("part"))
        right = pairs.join(members.select(F.col("node").alias("b"), F.col("component").alias("dst")), "dst").select("src", "part", "b")
        return left.join(right.hint("merge"), ["src", "part"]).select(*out)

    def _fixpoint(self, names, rules, start, lower, columns, value_of, seed) -> dict[str, DataFrame]:
        """Semi-naive rounds over the relations of one stratum."""
        spark = self.spark
        schemas = {n: self.relations[n].schema for n in names}
        static: dict[str, tuple[DataFrame, str]] = {}
        pieces: dict[str, list[tuple[str, int]]] = {n: [] for n in names}  # of each relation, with their rows

        def fixed(lit: Literal, number: int) -> DataFrame:
            # what the rounds read again and again is computed once
            if lit.relation not in static:
                side = lower(lit, number)
                static[lit.relation] = store(side if value_of(lit.relation) else side.distinct(), f"base-{lit.relation}")
            return static[lit.relation][0]

        def write(df: DataFrame, name: str) -> tuple[DataFrame, str, int]:
            """Writes the rows and counts them on the way."""
            path, seen = scratch_path(spark, name), Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            return spark.read.schema(df.schema).parquet(path), path, seen.get["n"]

        def log(n: str) -> DataFrame:
            # a relation only grows: every round adds a piece, also to replace values, and all pieces are the relation
            return spark.read.schema(schemas[n]).parquet(*(path for path, _ in pieces[n]))

        def total(n: str) -> int:
            return sum(rows for _, rows in pieces[n])

        def whole(n: str) -> DataFrame:
            rel = self.relations[n]
            return log(n) if rel.value is None or rel.merge == "first" else rel.normal(log(n))

        def add(n: str, df: DataFrame) -> DataFrame | None:
            """Writes a round's rows as a piece; None if there are none."""
            out, path, rows = write(df.select(*schemas[n].names), f"fix-{n}")
            if rows or not pieces[n]:
                pieces[n].append((path, rows))
            else:
                discard(spark, path)
            return out if rows else None

        def join_pieces(n: str) -> None:
            """Joins the later pieces once there are many, those that aren't larger than what came after: each row moves a few times only."""
            if len(pieces[n]) <= PIECES:
                return
            sizes = [rows for _, rows in pieces[n]]
            first = next((k for k in range(len(sizes) - 1) if sizes[k] <= 2 * sum(sizes[k + 1 :])), len(sizes) - 2)
            rest = pieces[n][first:]
            rows = sum(sizes[first:])
            _, path, _ = write(spark.read.schema(schemas[n]).parquet(*(path for path, _ in rest)).coalesce(1 + rows // 2_000_000), f"fix-{n}")
            pieces[n][first:] = [(path, rows)]
            joined.extend(path for path, _ in rest)

        def known(n: str, new: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
            """The new rows, and the relation's rows of their keys at least, whose values are merged.

            A large relation is not shuffled for that: the new rows are written and, if they are few by their count,
            broadcast to it; what comes back is no larger than they are (times the pieces that a value is in).
            """
            rel, scratch = self.relations[n], []
            if total(n) > LARGE:
                new, path, rows = write(new, f"new-{n}")
                scratch.append(path)
                if rows <= BROADCAST_ROWS:
                    found = log(n).join(F.broadcast(new.select(*rel.keys)), rel.keys, "left_semi")
                    return new, found if rel.value is None else rel.normal(found), scratch
            return new, whole(n), scratch

        def finish(rounds: int, unread: Iterable[str] = ()) -> None:
            self.rounds.update(dict.fromkeys(names, rounds))
            for path in [*(path for _, path in static.values()), *joined, *unread]:
                discard(spark, path)

        def edges() -> tuple[DataFrame, int]:
            """The edges along which a walk goes on, and their number."""
            sides = [join_body(body, fixed, columns, value_of, [a, b]).toDF("a", "b") for body, a, b in walk[1]]
            df = sides[0]
            for s in sides[1:]:
                df = df.unionByName(s)
            df, path, n = write(df.dropna().distinct(), "edges")
            joined.append(path)
            return df, n

        def closes(n: str, graph: tuple[DataFrame, int]) -> bool:
            """Whether the walk makes all pairs of its graph: it starts from its edges and nothing else."""
            if begun[n][1] != graph[1]:
                return False
            df = spark.read.schema(schemas[n]).parquet(begun[n][0])
            return df.select(F.col(columns(n)[1 - walk[0]]).alias("a"), F.col(columns(n)[walk[0]]).alias("b")).join(graph[0], ["a", "b"]).count() == graph[1]

        def walked(n: str) -> DataFrame:
            """The relation with all that its rows lead to along the edges; its other columns are the goal's constants."""
            node = columns(n)[walk[0]]
            cols = [(F.col("node") if k == walk[0] else F.lit(seed[k]).cast(schemas[n][c].dataType)).alias(c) for k, c in enumerate(columns(n))]
            found = graphs.reached(graph[0], log(n).select(node).dropna()).select(*cols)
            _, path, rows = write(found.unionByName(log(n).where(F.col(node).isNull())).select(*schemas[n].names), f"fix-{n}")
            joined.extend(path for path, _ in pieces[n])
            pieces[n][:] = [(path, rows)]
            return whole(n)

        walk = self._walk(names, rules) if self._condense else None
        pairs = walk is not None and not seed and len({f.dataType for f in schemas[next(iter(names))]}) == 1 and len(schemas[next(iter(names))]) == 2
        graph: tuple[DataFrame, int] | None = None
        joined: list[str] = []
        delta: dict[str, DataFrame | None] = {n: add(n, start(n)) for n in names}
        begun = {n: pieces[n][0] for n in names}
        for k in range(1, self.max_rounds + 1):
            if not any(d is not None for d in delta.values()):
                finish(k - 1)
                return {n: whole(n) for n in names}
            if walk and k > DEEP and len(seed) == len(columns(n := next(iter(names)))) - 1:
                graph = graph or edges()
                if max(graph[1], total(n)) <= graphs.EDGES:
                    out = walked(n)
                    finish(k)
                    return {n: out}
            if walk and pairs and total(n := next(iter(names))) > max(LARGE, GROWTH * begun[n][1]):
                pairs = begun[n][1] <= graphs.EDGES and closes(n, graph := graph or edges())
                if pairs:
                    out = self._by_components(n, graph[0], walk[0])
                    finish(k - 1, [path for path, _ in pieces[n]])
                    return {n: out}
            fresh: dict[str, DataFrame] = {}
            for n in names:
                rel = self.relations[n]
                parts = []
                for r in (x for x in rules if x.head.relation == n):
                    for i, lit in enumerate(r.body.literals()):
                        if lit.relation not in names or delta[lit.relation] is None:
                            continue

                        def side(x: Literal, number: int, i: int = i) -> DataFrame:
                            if x.relation not in names:
                                return fixed(x, number)
                            return delta[x.relation] if number == i else whole(x.relation)

                        parts.append(apply_rule(r, side, columns, value_of).select(*schemas[n].names))
                if parts:
                    new = parts[0]
                    for p in parts[1:]:
                        new = new.unionByName(p)
                    fresh[n] = rel.normal(new)
            later: dict[str, DataFrame | None] = dict.fromkeys(names)
            found = {n: known(n, new) for n, new in fresh.items()}  # what a round derives comes from the state before it
            for n, (new, old, scratch) in found.items():
                rel = self.relations[n]
                if rel.value is None:
                    new = new.join(old, rel.keys, "left_anti")
                else:
                    new = new.join(old.withColumnRenamed(rel.value, "_old"), rel.keys, "left")
                    better = {"min": F.col(rel.value) < F.col("_old"), "max": F.col(rel.value) > F.col("_old"), "or": F.col(rel.value) & ~F.col("_old"), "and": ~F.col(rel.value) & F.col("_old"), "first": F.lit(False)}[rel.merge]
                    new = new.where(F.col("_old").isNull() | better).select(*schemas[n].names)
                later[n] = add(n, new)
                for path in scratch:
                    discard(spark, path)
            for n in names:
                join_pieces(n)
            delta = later
        raise RuntimeError(f"no fixed point of {', '.join(names)} within {self.max_rounds} rounds")

    def query(self, goal: Body) -> DataFrame:
        """Answers of a conjunctive goal: variable bindings, or the whole tuples of literals marked ``row``.

        Constants of a goal's literal over a recursive relation are pushed into the recursion where that is sound.
        """
        parts = []
        for body in expand(goal):
            bound = {v for x in body.literals() if not x.negated for v in x.own_vars()}
            loose = [v for x in body.literals() if x.negated for v in x.own_vars() if v not in bound]
            if loose:
                raise ValueError(f"{goal!r}: variables {loose} of a negated literal are not bound")
            parts.append(self._answers(body))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if len(parts) == 1 and self._is_set(goal) else out.distinct()

    def _is_set(self, goal: Body) -> bool:
        """Whether the goal is one literal over a derived or merged relation, each variable in one place: distinct as it is."""
        if not isinstance(goal, Literal) or len(set(goal.own_vars())) < len(goal.own_vars()) or not goal.own_vars():
            return False
        rel = self.relations[goal.relation]
        derived = any(r.head.relation == goal.relation for r in self.rules)
        return (derived or rel.value is not None) and (rel.value is None or goal.row) and rel.make_row is None

    def _answers(self, body: Body) -> DataFrame:
        def relation(lit: Literal, _: int) -> DataFrame:
            constants = {k: a for k, a in enumerate(lit.args) if not isinstance(a, Var)}
            return self._rows(lit.relation, constants)

        need = list(dict.fromkeys(v for x in body.literals() if not x.negated for v in x.own_vars()))
        columns, value_of = (lambda n: self.relations[n].keys), (lambda n: self.relations[n].value)
        rows = [x for x in body.literals() if x.row]
        if not rows:
            return join_body(body, relation, columns, value_of, need)
        if len(rows) > 1:
            raise ValueError("a query returns the rows of one literal")
        lit, rel = rows[0], self.relations[rows[0].relation]
        value = [rel.value] if rel.value else []
        df = join_body(Combine("+", tuple(And((body,)).literals())) if value and len([x for x in body.literals() if value_of(x.relation)]) == 1 else body, relation, columns, value_of, need)
        cols = [(F.col(a.name) if isinstance(a, Var) else F.lit(a).cast(rel.schema[c].dataType)).alias(c) for c, a in zip(rel.keys, lit.args, strict=True)]
        if value and "_value" in df.columns:
            cols.append(F.col("_value").alias(rel.value))
        df = df.select(*cols)
        return df.select(rel.make_row(*(F.col(c) for c in df.columns)).alias("row")) if rel.make_row else df


def problem(spark: SparkSession, edb: dict[Relation, Iterable[tuple]], rules: Iterable[Rule], goal: Body, declared: Iterable[Relation]) -> DataFrame:
    """Assembles a program from its three parts and answers its goal."""
    p = Program(spark)
    for r in declared:
        p.relations[r.name] = r
    for r, rows in edb.items():
        p.facts(r, rows)
    for r in rules:
        p.rule(r)
    p.validate()
    return p.query(goal)


__all__ = ["BOOLEAN", "MAX_MIN", "MAX_TIMES", "MIN_PLUS", "Program", "Relation", "Semiring", "problem", "row", "scan"]
