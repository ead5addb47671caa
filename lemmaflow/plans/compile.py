"""Bodies as DataFrame plans: each literal is a scan with filters, a conjunction is a chain of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import And, Body, Combine, Literal, Rule, Var

#: How literals' values are combined.
TIMES: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "*": lambda a, b: a * b,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "and": lambda a, b: a & b,
}

Scan = Callable[[Literal, int], DataFrame]


def scan(df: DataFrame, columns: list[str], literal: Literal, value: str | None, value_as: str | None = None) -> DataFrame:
    """The literal's bindings: constants filter, a repeated variable is an equality, columns take variables' names."""
    if len(columns) != len(literal.args):
        raise ValueError(f"{literal!r}: {literal.relation} has {len(columns)} columns")
    first: dict[Var, str] = {}
    for name, arg in zip(columns, literal.args, strict=True):
        if not isinstance(arg, Var):
            df = df.where(F.col(name) == F.lit(arg))
        elif arg in first:
            df = df.where(F.col(first[arg]) == F.col(name))
        else:
            first[arg] = name
    out = [F.col(c).alias(v.name) for v, c in first.items()]
    if value_as:
        out.append((F.col(value) if value else F.lit(None)).alias(value_as))
    if not out:  # no variables: the literal is a test
        return df.select(F.lit(True).alias("_holds")).limit(1)
    return df.select(*out)


def order(literals: list[tuple[int, Literal]]) -> list[tuple[int, Literal]]:
    """Constants first, then whatever shares a variable with what is there, negated literals at the end."""
    rest = [x for x in literals if not x[1].negated]
    out: list[tuple[int, Literal]] = []
    bound: set[Var] = set()
    while rest:
        best = max(rest, key=lambda x: (bool(bound & set(x[1].own_vars())), sum(not isinstance(a, Var) for a in x[1].args), -x[0]))
        rest.remove(best)
        out.append(best)
        bound |= set(best[1].own_vars())
    return out + [x for x in literals if x[1].negated]


def join_body(body: Body, relation: Scan, columns: Callable[[str], list[str]], value_of: Callable[[str], str | None], need: list[Var]) -> DataFrame:
    """Bindings of a body without choices: the variables of ``need``, and ``_value`` if the body combines values.

    ``relation(literal, number)`` is the table of a literal. A literal that brings no variable that is needed
    later is a semi join, a negated one an anti join.
    """
    combined = isinstance(body, Combine)
    literals = order(list(enumerate(body.literals())))
    later: list[set[Var]] = [set(need)]
    for _, lit in reversed(literals[1:]):
        later.append(later[-1] | set(lit.own_vars()))
    later.reverse()
    df: DataFrame | None = None
    bound: set[Var] = set()
    values: dict[int, str] = {}
    for (number, lit), after in zip(literals, later, strict=True):
        valued = combined and not lit.negated and value_of(lit.relation) is not None
        tag = f"_value{number}" if valued else None
        side = scan(relation(lit, number), columns(lit.relation), lit, value_of(lit.relation), tag)
        own = set(lit.own_vars())
        shared = [v.name for v in lit.own_vars() if v in bound]
        if lit.negated:
            side = side.select(*(v.name for v in lit.own_vars())).distinct() if own else side
            df = df.join(side, shared, "left_anti") if own else df.join(side, F.lit(True), "left_anti")
            continue
        if valued:
            values[number] = tag
        if df is None:
            df = side
        elif not own:
            df = df.join(side, F.lit(True), "left_semi") if not valued else df.crossJoin(side)
        elif shared and not valued and not (own - bound) & after:
            df = df.join(side.select(*shared), shared, "left_semi")
        elif shared:
            df = df.join(side.select(*(v.name for v in lit.own_vars() if v in bound or v in after), *([tag] if tag else [])), shared)
        else:
            df = df.crossJoin(side)
        bound |= own
        keep = [v.name for v in bound if v in after]
        if set(keep) | set(values.values()) != set(df.columns) and keep:
            df = df.select(*keep, *values.values())
    if df is None:
        raise ValueError("an empty body has no plan")
    out: list[Any] = [F.col(v.name) for v in need]
    if combined:
        out.append(reduce(TIMES[body.op], (F.col(values[k]) for k in sorted(values))).alias("_value"))
    return df.select(*out) if out else df


def apply_rule(rule: Rule, relation: Scan, columns: Callable[[str], list[str]], value_of: Callable[[str], str | None]) -> DataFrame:
    """Head tuples of a rule without choices, with a ``value`` column if its head has one. Not yet distinct."""
    need = list(dict.fromkeys(rule.head.own_vars()))
    df = join_body(rule.body, relation, columns, value_of, need)
    names = columns(rule.head.relation)
    out = [(F.col(a.name) if isinstance(a, Var) else F.lit(a)).alias(n) for n, a in zip(names, rule.head.args, strict=True)]
    value = value_of(rule.head.relation)
    if value is not None:
        if not isinstance(rule.body, Combine) and rule.value is None:
            single = [x for x in rule.body.literals() if not x.negated and value_of(x.relation) is not None]
            if len(single) != 1:
                raise ValueError(f"{rule!r}: the value of the head must come from one literal, a combination or a number")
            df = join_body(Combine("+", tuple(And((rule.body,)).literals())), relation, columns, value_of, need)
        out.append((F.lit(rule.value) if rule.value is not None else F.col("_value")).alias(value))
    return df.select(*out)
