"""Expressions as columns, with the query language's own rules for nulls and mixed types.

Kinds are known before anything runs: each expression has one of null, bool, int, float, string, node, edge. What a
dynamically typed evaluator finds out row by row is decided here: comparisons of kinds that do not compare are
constants, operations on the wrong kinds are errors. Where no operand can be null the plain Spark operator is used,
which reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..plans import ast as A
from ..sources.catalog import SPARK, TAG_BITS

NUMBERS = ("int", "float")
ENTITIES = ("node", "edge")


@dataclass(frozen=True)
class Typed:
    """A column and what is known of it. ``fields`` has an entity's id, label (and an edge's ends) as columns."""

    col: Column
    kind: str
    nullable: bool = True
    fields: dict[str, Column] | None = None


class Scope(Protocol):
    def variable(self, name: str) -> Typed: ...

    def property(self, name: str, key: str) -> Typed: ...


def null(kind: str = "null") -> Typed:
    return Typed(F.lit(None).cast(SPARK[kind]), kind)


def _constant(value: bool) -> Typed:
    return Typed(F.lit(value), "bool", nullable=False)


def literal(value: object) -> Typed:
    if value is None:
        return null()
    kind = {bool: "bool", int: "int", float: "float", str: "string"}[type(value)]
    return Typed(F.lit(value).cast(SPARK[kind]), kind, nullable=False)


def truth(x: Typed) -> Column:
    """Whether a value counts as true; null where the value is null."""
    if x.kind == "bool":
        return x.col
    if x.kind in NUMBERS:
        return x.col != F.lit(0).cast(SPARK[x.kind])
    if x.kind == "string":
        return x.col != F.lit("")
    return F.lit(None).cast("boolean") if x.kind == "null" else F.lit(True)


def sure(x: Typed) -> Column:
    """``truth`` with false for null."""
    return F.coalesce(truth(x), F.lit(False)) if x.nullable else truth(x)


def display(x: Typed) -> Column:
    """A value as text, NULL for null."""
    if x.kind == "null":
        return F.lit("NULL")
    if x.kind in ENTITIES:
        return _entity_text(x)
    out = x.col.cast("string") if x.kind != "float" else float_text(x.col)
    return F.coalesce(out, F.lit("NULL")) if x.nullable else out


def _entity_text(x: Typed) -> Column:
    def number(c: Column, mark: str) -> Column:
        low = c.bitwiseAND(F.lit((1 << TAG_BITS) - 1))
        return F.concat(F.lit(mark), F.shiftright(c, TAG_BITS).cast("string"), F.lit(":"), low.cast("string"))

    f = x.fields
    label = F.coalesce(F.concat(F.lit(":"), f["label"], F.lit(" ")), F.lit(""))
    if x.kind == "node":
        return F.concat(F.lit("("), label, F.lit("{id: "), number(f["id"], "n"), F.lit("})"))
    ends = F.concat(number(f["src"], "n"), F.lit("->"), number(f["dst"], "n"))
    return F.concat(F.lit("["), label, F.lit("{id: "), number(f["id"], "e"), F.lit(", "), ends, F.lit("}]"))


def float_text(c: Column) -> Column:
    """A double in full digits: no exponent, and no fraction if it has none."""
    shown = F.abs(c).cast("string")
    mantissa, power = F.substring_index(shown, "E", 1), F.substring_index(shown, "E", -1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")  # one digit stands before the point
    length = F.length(digits)
    point = power + 1
    large = F.when(length <= point, F.rpad(digits, point, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, length)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(~shown.contains("E"), F.regexp_replace(shown, r"\.0$", "")).when(power > 0, large).otherwise(small)
    sign = F.when((c < 0) | (c.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(c), F.lit("NaN")).when(F.abs(c) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def _fail(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: '"), value, F.lit("'")))


class Compiler:
    """Columns for expressions in a scope.

    A tolerant compiler gives null where evaluation fails: sort keys and aggregates' arguments are read so.
    """

    def __init__(self, scope: Scope, tolerant: bool = False):
        self.scope, self.tolerant = scope, tolerant

    def value(self, e: A.Expr) -> Typed:
        if isinstance(e, A.Literal):
            return literal(e.value)
        if isinstance(e, A.Variable):
            return self.scope.variable(e.name)
        if isinstance(e, A.Property):
            return self._property(e)
        try:
            if isinstance(e, A.Unary):
                return self._unary(e)
            if isinstance(e, A.Binary):
                return self._binary(e)
            return self._call(e)
        except _KindError:
            if self.tolerant:
                return null()
            raise

    def condition(self, e: A.Expr) -> Column:
        """A filter's predicate: rows stay where it is true, so that null and false are one."""
        if isinstance(e, A.Binary) and e.op == "AND":
            return self.condition(e.left) & self.condition(e.right)
        return truth(self.value(e))

    # -- access

    def _property(self, e: A.Property) -> Typed:
        if not isinstance(e.of, A.Variable):
            raise AnalysisError(f"{A.text(e)}: only variables have properties")
        return self.scope.property(e.of.name, e.name)

    # -- operators

    def _unary(self, e: A.Unary) -> Typed:
        if e.op == "NOT":
            # inside NOT, null and false are one as well, and a conjunction needs no strict nulls
            return Typed(~F.coalesce(self.condition(e.of), F.lit(False)), "bool", nullable=False)
        x = self.value(e.of)
        if e.op in ("IS NULL", "IS NOT NULL"):
            is_null = F.lit(True) if x.kind == "null" else (x.fields["id"] if x.fields else x.col).isNull() if x.nullable else F.lit(False)
            return Typed(is_null if e.op == "IS NULL" else ~is_null, "bool", nullable=False)
        if x.kind == "null":
            return x
        self._need(e, NUMBERS, x)
        return Typed(-x.col, x.kind, x.nullable)

    def _binary(self, e: A.Binary) -> Typed:
        a, b = self.value(e.left), self.value(e.right)
        if e.op in ("AND", "OR"):
            return self._logic(e.op, a, b)
        if e.op in ("=", "<>"):
            same = self._equal(a, b)
            return Typed(same if e.op == "=" else ~same, "bool", nullable=False)
        if a.kind == "null" or b.kind == "null":
            return null("bool") if e.op not in "+-*/%" else null()
        nullable = a.nullable or b.nullable
        if e.op in ("<", "<=", ">", ">="):
            return self._compare(e.op, a, b, nullable)
        if e.op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
            self._need(e, ("string",), a, b)
            test: Callable = {"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}[e.op]
            return Typed(test(a.col, b.col), "bool", nullable)
        self._need(e, NUMBERS, a, b)
        return self._arithmetic(e.op, a, b, nullable)

    @staticmethod
    def _logic(op: str, a: Typed, b: Typed) -> Typed:
        both = truth(a) & truth(b) if op == "AND" else truth(a) | truth(b)
        missing = [x.col.isNull() if x.kind != "null" else F.lit(True) for x in (a, b) if x.nullable and x.kind not in ENTITIES]
        if not missing:
            return Typed(both, "bool", nullable=False)
        # a null operand makes the whole null, even where the other one would decide
        any_missing = missing[0] if len(missing) == 1 else missing[0] | missing[1]
        return Typed(F.when(~any_missing, both), "bool")

    @staticmethod
    def _equal(a: Typed, b: Typed) -> Column:
        """Two-valued: null equals null and nothing else."""
        if a.kind in ENTITIES or b.kind in ENTITIES:
            return a.fields["id"].eqNullSafe(b.fields["id"]) if a.kind == b.kind else F.lit(False)
        if a.kind == "null" and b.kind == "null":
            return F.lit(True)
        if a.kind == "null" or b.kind == "null":
            x = b if a.kind == "null" else a
            return x.col.isNull() if x.nullable else F.lit(False)
        if a.kind == b.kind or {a.kind, b.kind} == {"int", "float"}:
            return a.col.eqNullSafe(b.col) if a.nullable or b.nullable else a.col == b.col
        return a.col.isNull() & b.col.isNull() if a.nullable and b.nullable else F.lit(False)

    @staticmethod
    def _compare(op: str, a: Typed, b: Typed, nullable: bool) -> Typed:
        if a.kind in ENTITIES or b.kind in ENTITIES or not (a.kind == b.kind or {a.kind, b.kind} == {"int", "float"}):
            fixed = F.lit("=" in op)  # kinds that have no order between them count as equal
            missing = [x.col.isNull() for x in (a, b) if x.nullable and x.kind not in ENTITIES]
            for m in missing:
                fixed = F.when(~m, fixed)
            return Typed(fixed, "bool", bool(missing))
        x, y = a.col, b.col
        return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool", nullable)

    def _arithmetic(self, op: str, a: Typed, b: Typed, nullable: bool) -> Typed:
        kind = "int" if a.kind == b.kind == "int" else "float"
        x, y = a.col.cast(SPARK[kind]), b.col.cast(SPARK[kind])
        if op in "+-*":
            if self.tolerant:
                return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), kind)
            return Typed({"+": x + y, "-": x - y, "*": x * y}[op], kind, nullable)
        zero = y == F.lit(0).cast(SPARK[kind])
        if op == "%" and kind == "float":
            return Typed(F.when(zero, F.lit(float("nan"))).otherwise(x % y), kind, nullable)
        out = F.call_function("div", x, y) if op == "/" and kind == "int" else x / y if op == "/" else x % y
        return Typed(F.when(~zero, out), kind) if self.tolerant else Typed(out, kind, nullable)

    @staticmethod
    def _need(e: A.Expr, kinds: tuple[str, ...], *operands: Typed) -> None:
        for x in operands:
            if x.kind not in kinds:
                raise _KindError(f"{A.text(e)}: {x.kind} is not {' or '.join(kinds)}")

    # -- functions

    def _call(self, e: A.Call) -> Typed:
        name = e.name.lower()
        found = getattr(self, f"_fn_{name}", None)
        if found is None:
            raise AnalysisError(f"there is no function {e.name}")
        if not e.args:
            raise AnalysisError(f"{e.name} needs an argument")
        return found(e, self.value(e.args[0]))

    def _fn_id(self, e: A.Call, x: Typed) -> Typed:
        self._need(e, ENTITIES, x)
        return Typed(x.fields["id"], "int", x.nullable)

    def _fn_type(self, e: A.Call, x: Typed) -> Typed:
        self._need(e, ("edge",), x)
        return Typed(x.fields["label"], "string")

    def _fn_labels(self, e: A.Call, x: Typed) -> Typed:
        self._need(e, ("node",), x)
        return Typed(x.fields["label"], "string")

    def _fn_tostring(self, e: A.Call, x: Typed) -> Typed:
        return Typed(display(x), "string", nullable=False)

    def _fn_tointeger(self, e: A.Call, x: Typed) -> Typed:
        if x.kind in ("null", "int"):
            return x if x.kind == "int" else null("int")
        self._need(e, ("float", "bool", "string"), x)
        if x.kind == "bool":
            return Typed(x.col.cast("int").cast("bigint"), "int", x.nullable)
        if x.kind == "float":
            # toward zero, held at the ends of the range; 2**63 is the first double beyond it
            top, low = F.lit(2**63 - 1).cast("bigint"), F.lit(-(2**63)).cast("bigint")
            return Typed(F.when(F.isnan(x.col), F.lit(0).cast("bigint")).when(x.col >= 2.0**63, top).when(x.col < -(2.0**63), low).otherwise(x.col.cast("bigint")), "int", x.nullable)
        good = x.col.rlike(r"\A[+-]?[0-9]+\z")
        return self._parsed(x, good, "bigint", "int")

    def _fn_tofloat(self, e: A.Call, x: Typed) -> Typed:
        if x.kind in ("null", "float"):
            return x if x.kind == "float" else null("float")
        self._need(e, ("int", "string"), x)
        if x.kind == "int":
            return Typed(x.col.cast("double"), "float", x.nullable)
        good = x.col.rlike(r"\A[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z")
        return self._parsed(x, good, "double", "float")

    def _parsed(self, x: Typed, good: Column, to: str, kind: str) -> Typed:
        if self.tolerant:
            return Typed(F.when(good, x.col.try_cast(to)), kind)
        return Typed(F.when(x.col.isNull() | good, x.col.cast(to)).otherwise(_fail(f"not a {kind}", x.col).cast(to)), kind, x.nullable)


class _KindError(AnalysisError):
    """An operand of the wrong kind."""


#: name -> aggregate over a numeric column
_NUMERIC = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}
AGGREGATES = frozenset({"count", *_NUMERIC})


def is_aggregate(e: A.Expr) -> bool:
    return isinstance(e, A.Call) and e.name.lower() in AGGREGATES


def aggregate(e: A.Call, scope: Scope, times: Column | None = None) -> Column:
    """A global aggregate. Values that are no numbers, or fail, do not count for sums, means and extremes.

    ``times`` is how often each row counts, for COUNT.
    """
    count = F.count if times is None else lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), times)), F.lit(0).cast("long"))
    name = e.name.lower()
    if name == "count":
        if e.star or not e.args:
            return count(F.lit(1))
        x = Compiler(scope, tolerant=True).value(e.args[0])
        return count(x.fields["id"] if x.fields else x.col) if x.nullable else count(F.lit(1))
    x = Compiler(scope, tolerant=True).value(e.args[0]) if e.args else null()
    number = x.col.cast("double") if x.kind in NUMBERS else F.lit(None).cast("double")
    return _NUMERIC[name](number)
