"""Terms, literals and rules of the rule language (the values a program is made of)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Var:
    """A logic variable; ``kind`` optionally names the Spark type its column must have."""

    name: str
    kind: str | None = field(default=None, compare=False)

    def __repr__(self) -> str:
        return self.name


def variables(names: str, kind: str | None = None) -> tuple[Var, ...]:
    """``variables("X Y Z")`` makes three variables."""
    return tuple(Var(n, kind) for n in names.replace(",", " ").split())


class Body:
    """Anything that can stand in a body: ``&`` (or ``<<=`` style chains) joins, ``|`` is a choice."""

    def __and__(self, other: Body) -> And:
        return And((*_parts(self, And), *_parts(other, And)))

    def __or__(self, other: Body) -> Or:
        return Or((*_parts(self, Or), *_parts(other, Or)))

    def __add__(self, other: Body) -> Combine:
        return Combine("+", (*_terms(self, "+"), *_terms(other, "+")))

    def __mul__(self, other: Body) -> Combine:
        return Combine("*", (*_terms(self, "*"), *_terms(other, "*")))

    def vars(self) -> list[Var]:
        """Variables by first occurrence."""
        return list(dict.fromkeys(v for lit in self.literals() for v in lit.own_vars()))

    def literals(self) -> Iterator[Literal]:
        raise NotImplementedError


def _parts(b: Body, kind: type) -> tuple[Body, ...]:
    return b.items if isinstance(b, kind) else (b,)


def _terms(b: Body, op: str) -> tuple[Body, ...]:
    return b.items if isinstance(b, Combine) and b.op == op else (b,)


@dataclass(frozen=True)
class Literal(Body):
    """A relation applied to variables and constants; ``negated`` asks for absence, ``row`` for the whole tuple."""

    relation: str
    args: tuple[Any, ...]
    negated: bool = False
    row: bool = False

    def own_vars(self) -> list[Var]:
        return [a for a in self.args if isinstance(a, Var)]

    def literals(self) -> Iterator[Literal]:
        yield self

    def substitute(self, binding: dict[Var, Any]) -> Literal:
        """The literal with variables replaced by what ``binding`` has for them."""
        return replace(self, args=tuple(binding.get(a, a) if isinstance(a, Var) else a for a in self.args))

    def when(self, body: Body | float | int) -> Rule:
        """The rule ``self :- body``; a number instead of a body is a fact's value."""
        return Rule(self, body) if isinstance(body, Body) else Rule(self, And(()), value=body)

    def __repr__(self) -> str:
        text = f"{self.relation}({', '.join(map(repr, self.args))})"
        text = f"row({text})" if self.row else text
        return f"no({text})" if self.negated else text


@dataclass(frozen=True)
class And(Body):
    items: tuple[Body, ...]

    def literals(self) -> Iterator[Literal]:
        for i in self.items:
            yield from i.literals()

    def __repr__(self) -> str:
        return " & ".join(f"({i!r})" if isinstance(i, Or) else repr(i) for i in self.items)


@dataclass(frozen=True)
class Or(Body):
    items: tuple[Body, ...]

    def literals(self) -> Iterator[Literal]:
        for i in self.items:
            yield from i.literals()

    def __repr__(self) -> str:
        return " | ".join(map(repr, self.items))


@dataclass(frozen=True)
class Combine(Body):
    """A conjunction whose literals' values are combined: ``tc(X, Y) + edge(Y, Z)``."""

    op: str
    items: tuple[Body, ...]

    def literals(self) -> Iterator[Literal]:
        for i in self.items:
            yield from i.literals()

    def __repr__(self) -> str:
        return f" {self.op} ".join(map(repr, self.items))


@dataclass(frozen=True)
class Rule:
    """``head :- body``. A rule without body literals and variables is a fact."""

    head: Literal
    body: Body
    value: Any = None

    def vars(self) -> list[Var]:
        """Variables by first occurrence, the head's first."""
        return list(dict.fromkeys([*self.head.own_vars(), *self.body.vars()]))

    @property
    def bindings(self) -> int:
        return len(self.vars())

    def normalized(self) -> Rule:
        """The rule with its variables renamed v0, v1, ... by first occurrence, the head's first.

        Rules that differ in the names of variables alone become equal, so this is a key for plans.
        """
        names = {v: Var(f"v{k}", v.kind) for k, v in enumerate(self.vars())}
        return Rule(self.head.substitute(names), rename(self.body, names), self.value)

    def alternatives(self) -> list[Rule]:
        """Rules without choices that together say the same (the body's disjunctive normal form)."""
        return [Rule(self.head, b, self.value) for b in expand(self.body)]

    def problems(self, negation_binds: bool = False) -> list[str]:
        """What makes the rule illegal; nothing if it is fine."""
        found = []
        for alternative in expand(self.body):
            bound = {v for lit in alternative.literals() if not lit.negated for v in lit.own_vars()}
            free = [v for v in self.head.own_vars() if v not in bound]
            if free:
                found.append(f"{self!r}: head variables {free} are not bound by the body")
            for lit in alternative.literals():
                loose = [v for v in lit.own_vars() if v not in bound] if lit.negated else []
                if loose:
                    found.append(f"{self!r}: variables {loose} of a negated literal are not bound")
        return found

    def __repr__(self) -> str:
        if not list(self.body.literals()):
            return f"{self.head!r}" if self.value is None else f"{self.head!r} :- {self.value!r}"
        return f"{self.head!r} :- {self.body!r}"


def rename(body: Body, names: dict[Var, Any]) -> Body:
    if isinstance(body, Literal):
        return body.substitute(names)
    return replace(body, items=tuple(rename(i, names) for i in body.items))


def expand(body: Body) -> list[Body]:
    """Bodies without choices whose union is the body."""
    if isinstance(body, Literal):
        return [body]
    if isinstance(body, Or):
        return [b for i in body.items for b in expand(i)]
    if isinstance(body, Combine):
        out: list[tuple[Body, ...]] = [()]
        for i in body.items:
            out = [(*o, b) for o in out for b in expand(i)]
        return [Combine(body.op, o) for o in out]
    flat: list[tuple[Body, ...]] = [()]
    for i in body.items:
        flat = [(*o, *_parts(b, And)) for o in flat for b in expand(i)]
    return [And(o) for o in flat]


def no(literal: Literal) -> Literal:
    """Absence of the literal's tuple."""
    return replace(literal, negated=True)


def row(literal: Literal) -> Literal:
    """Asks a query for the whole tuple of the literal, constants included."""
    return replace(literal, row=True)


def combine(times: str, *literals: Body) -> Combine:
    """A conjunction whose literals' values are combined by ``times``, one of ``compile.TIMES``."""
    return Combine(times, literals)
