"""Syntax trees of statements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    of: Expr
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -, IS NULL, IS NOT NULL
    of: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


Expr = Literal | Variable | Property | Call | Unary | Binary


@dataclass(frozen=True)
class Hops:
    """Least and most hops; ``most`` is None if it is open."""

    least: int
    most: int | None


@dataclass(frozen=True)
class NodePattern:
    variable: str | None
    label: str | None
    properties: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class EdgePattern:
    direction: str  # out, in, any
    variable: str | None
    label: str | None
    hops: Hops | None
    properties: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Path:
    """nodes[0] edges[0] nodes[1] ... nodes[-1]"""

    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...] = ()


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class Create:
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class Where:
    condition: Expr


@dataclass(frozen=True)
class SetItem:
    variable: str
    name: str
    value: Expr


@dataclass(frozen=True)
class Set:
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete:
    variables: tuple[str, ...]


@dataclass(frozen=True)
class ReturnItem:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class OrderItem:
    expr: Expr
    descending: bool


@dataclass
class Statement:
    """Clauses that run in order, and those that apply once at the end (the last one given of each kind)."""

    steps: list[Match | Create | Where | Set | Delete] = field(default_factory=list)
    returns: tuple[ReturnItem, ...] | None = None
    distinct: bool = False
    order: tuple[OrderItem, ...] = ()
    skip: int | None = None
    limit: int | None = None

    @property
    def writes(self) -> bool:
        return any(isinstance(s, (Create, Set, Delete)) for s in self.steps)


def walk(x: object) -> Iterator[object]:
    """Every tree node below and with ``x``."""
    yield x
    if is_dataclass(x):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, (tuple, list)):
        for y in x:
            yield from walk(y)


def variables(e: object) -> set[str]:
    """Names of the variables that an expression reads."""
    return {x.name for x in walk(e) if isinstance(x, Variable)}


def conjuncts(e: Expr) -> list[Expr]:
    """The parts of a condition that all have to hold."""
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def text(e: Expr) -> str:
    """An expression as a column's name."""
    if isinstance(e, Literal):
        if e.value is None:
            return "NULL"
        return str(e.value).upper() if isinstance(e.value, bool) else repr(e.value) if isinstance(e.value, str) else str(e.value)
    if isinstance(e, Variable):
        return e.name
    if isinstance(e, Property):
        return f"{text(e.of)}.{e.name}"
    if isinstance(e, Call):
        return f"{e.name}({'*' if e.star else ', '.join(map(text, e.args))})"
    if isinstance(e, Unary):
        return f"{text(e.of)} {e.op}" if e.op.startswith("IS") else f"{e.op} {text(e.of)}" if e.op == "NOT" else f"-{text(e.of)}"
    return f"{text(e.left)} {e.op} {text(e.right)}"
