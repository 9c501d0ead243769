"""Writes: CREATE, SET and DELETE as changes that are laid over an immutable graph.

A statement's rows are written, and numbered, before it changes anything, so that it never sees its own writes while it
matches; all that it creates for them are columns of that one table. Each change is a table of its own (ids and
values). A change can be laid over any version of the graph, be checked for conflicts by its ids, and be logged.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions.expr import Compiler, Typed
from ..plans import ast as A
from ..sources.catalog import CREATED, EDGE_COLUMNS, NODE_COLUMNS, NONE, SPARK, TAG_BITS, PropertyGraph, Table, common_kind, kind_of
from ..sources.shared import counted, written
from .compiler import Binding, Bindings, Planner

#: A table with so many changes on it is written anew.
DEEP = 8


@dataclass(frozen=True)
class Insert:
    """New rows of a label: ``df`` has the fixed columns and properties."""

    kind: str
    label: str
    df: DataFrame
    required: frozenset[str] = frozenset()
    ends: frozenset[tuple[str, str]] = frozenset()

    def over(self, g: PropertyGraph) -> PropertyGraph:
        g, _ = g.tag(self.kind, self.label)
        old = g.tables(self.kind).get(self.label)
        if old is None:
            return g.with_table(self.kind, self.label, Table(self.df, self.required, self.ends or None, 1))
        have, new = old.properties(), Table(self.df).properties()
        left, right = old.df, self.df
        for name in have.keys() & new.keys():
            kind = common_kind((have[name], new[name]), f"property {name} of {self.label}")
            left, right = (x.withColumn(name, F.col(name).cast(SPARK[kind])) if k != kind else x for x, k in ((left, have[name]), (right, new[name])))
        ends = None if old.ends is None else old.ends | self.ends
        return g.with_table(self.kind, self.label, Table(left.unionByName(right, allowMissingColumns=True), old.required & self.required, ends, old.depth + 1))


@dataclass(frozen=True)
class Update:
    """One property of the given rows: ``df`` has ``_id`` and ``value``, an id once."""

    kind: str
    labels: tuple[str, ...]
    name: str
    df: DataFrame

    def over(self, g: PropertyGraph) -> PropertyGraph:
        given = kind_of(self.df.schema["value"].dataType)
        for label in self.labels:
            t = g.tables(self.kind).get(label)
            if t is None:
                continue
            kind = common_kind((t.properties().get(self.name, "null"), given), f"property {self.name} of {label}")
            if kind == "null":
                continue
            old = (F.col(self.name) if self.name in t.properties() else F.lit(None)).cast(SPARK[kind])
            new = self.df.select(F.col("_id").alias("__id"), F.col("value").cast(SPARK[kind]).alias("__value"))
            df = t.df.join(new, t.df["_id"] == new["__id"], "left")
            df = df.withColumn(self.name, F.when(F.col("__id").isNotNull(), F.col("__value")).otherwise(old)).drop("__id", "__value")
            g = g.with_table(self.kind, label, Table(df, t.required - {self.name}, t.ends, t.depth + 1))
        return g


@dataclass(frozen=True)
class Remove:
    """Rows that go: ``df`` has ``_id``. Edges of removed nodes stay."""

    kind: str
    labels: tuple[str, ...]
    df: DataFrame

    def over(self, g: PropertyGraph) -> PropertyGraph:
        for label in self.labels:
            if t := g.tables(self.kind).get(label):
                g = g.with_table(self.kind, label, replace(t, source=t.df.join(self.df, "_id", "left_anti"), depth=t.depth + 1))
        return replace(g, whole=False) if self.kind == "node" else g


Change = Insert | Update | Remove


def compacted(g: PropertyGraph) -> PropertyGraph:
    """``g`` with tables under many changes written anew."""
    for kind in ("node", "edge"):
        for label, t in g.tables(kind).items():
            if t.depth >= DEEP:
                g = g.with_table(kind, label, replace(t, source=written(t.df, "graph"), depth=0))
    return g


class Writer:
    """Runs a statement's steps, and gathers its changes."""

    def __init__(self, graph: PropertyGraph, statement: A.Statement, allocate):
        self.graph, self.allocate = graph, allocate
        self.planner = Planner(graph, statement)
        self.statement, self.changes = statement, []
        #: Rows of the bindings, while they are those that the last write had; their numbers are the column <n>.
        self.rows: int | None = None

    def run(self) -> tuple[DataFrame, int | None]:
        """The statement's result, and the number of rows it wrote for (None if it wrote nothing)."""
        s, steps, k = Bindings(self.graph), self.statement.steps, 0
        while k < len(steps):
            step = steps[k]
            k += 1
            if isinstance(step, (A.Match, A.Where)):
                self.rows = None
            if isinstance(step, A.Match):
                where = []
                while k < len(steps) and isinstance(steps[k], A.Where):
                    where += A.conjuncts(steps[k].condition)
                    k += 1
                s = self.planner.match(s, step, where)
            elif isinstance(step, A.Where):
                if s.df is None:
                    raise AnalysisError("WHERE needs a MATCH before it")
                s = self.planner.filter(s, *A.conjuncts(step.condition))
            else:
                s = self.write(s, step)
        n = None
        if self.changes:
            n = s.df.count() if self.rows is None else self.rows
        return self.planner.finish(s), n

    def write(self, s: Bindings, step: A.Create | A.Set | A.Delete) -> Bindings:
        if s.df is None:
            if not isinstance(step, A.Create):
                raise AnalysisError("SET and DELETE need a MATCH before them")
            s, self.rows = replace(s, df=self.graph.spark.range(1).select(F.lit(0).cast("long").alias("<n>"))), 1
        if self.rows is None:
            df, self.rows = counted(s.df.drop("<n>"), "bindings", "<n>")
            s = replace(s, df=df)
        if isinstance(step, A.Create):
            for path in step.paths:
                s = self.create(s, path)
        elif isinstance(step, A.Set):
            for item in step.items:
                s = self.set(s, item)
        else:
            for name in step.variables:
                b = s.binding(name)
                self.change(Remove(b.kind, b.labels, written(s.df.select(b.id.alias("_id")).distinct(), "removed")))
        return s

    def change(self, c: Change) -> None:
        self.changes.append(c)
        self.graph = c.over(self.graph)
        self.planner.graph = self.graph

    # -- CREATE

    def values(self, s: Bindings, properties) -> dict[str, Typed]:
        found = {k: Compiler(s).value(v) for k, v in properties}
        for k, x in found.items():
            if x.fields:
                raise AnalysisError(f"the property {k} cannot be a {x.kind}")
        return {k: x for k, x in found.items() if x.kind != "null"}

    def insert(self, s: Bindings, kind: str, variable: str | None, label: str | None, properties, ends: tuple[Binding, Binding] | None = None) -> tuple[Bindings, str]:
        label = label or NONE
        values = self.values(s, properties)
        self.graph, tag = self.graph.tag(kind, label)
        first = self.allocate(self.rows)
        b = Binding(kind, self.planner.prefix(), (label,), tuple(values))
        own_id = (F.lit((tag << TAG_BITS) | (CREATED + first)) + F.col("<n>")).alias(f"{b.prefix}#id")
        extra = [own_id, F.lit(label or None).cast("string").alias(f"{b.prefix}#label")]
        if ends:
            extra += [ends[0].id.alias(f"{b.prefix}#src"), ends[1].id.alias(f"{b.prefix}#dst")]
        extra += [x.col.cast(SPARK[x.kind]).alias(f"{b.prefix}.{k}") for k, x in values.items()]
        df = s.df.select("*", *extra)
        fixed = NODE_COLUMNS if kind == "node" else EDGE_COLUMNS
        new = df.select(*(b.col(c[1:]).alias(c) for c in fixed), *(b.prop(k).alias(k) for k in values))
        pairs = frozenset((x, y) for x in ends[0].labels for y in ends[1].labels) if ends else frozenset()
        self.change(Insert(kind, label, new, frozenset(k for k, x in values.items() if not x.nullable), pairs))
        name = variable or f"<{b.prefix}>"
        return replace(s, graph=self.graph, df=df, variables={**s.variables, name: b}), name

    def create(self, s: Bindings, path: A.Path) -> Bindings:
        """New nodes from left to right, bound ones as they are, then the edges between them."""
        names = []
        for n in path.nodes:
            if n.variable in s.variables:
                names.append(n.variable)
                continue
            s, name = self.insert(s, "node", n.variable, n.label, n.properties)
            names.append(name)
        for k, e in enumerate(path.edges):
            if e.hops is not None:
                raise AnalysisError("CREATE takes no quantified edges")
            a, b = s.variables[names[k]], s.variables[names[k + 1]]
            if "edge" in (a.kind, b.kind):
                raise AnalysisError("edges connect nodes")
            s, _ = self.insert(s, "edge", e.variable, e.label, e.properties, (b, a) if e.direction == "in" else (a, b))
        return s

    # -- SET

    def set(self, s: Bindings, item: A.SetItem) -> Bindings:
        b = s.binding(item.variable)
        x = Compiler(s).value(item.value)
        if x.fields:
            raise AnalysisError(f"the property {item.name} cannot be a {x.kind}")
        had = self.graph.property_kind(b.kind, b.labels, item.name)
        kind = common_kind((had, x.kind), f"property {item.name}")
        if kind == "null":
            return s
        value: Column = x.col.cast(SPARK[kind])
        df = s.df.withColumn(f"{b.prefix}.{item.name}", value)
        s = replace(s, df=df, kinds={**s.kinds, (item.variable, item.name): kind})
        b = replace(b, names=tuple(dict.fromkeys([*b.names, item.name])))
        # an id that several rows set gets the last one's value, rows being in the order of the ids that they bind: the
        # same on each run. It is in a struct, which is not null where the value is
        order = F.struct(*(x.id.alias(f"o{k}") for k, x in enumerate(s.variables.values())))
        last = F.max_by(F.struct(b.prop(item.name).alias("value")), order)
        rows = s.df.groupBy(b.id.alias("_id")).agg(last.alias("l")).select("_id", "l.value")
        self.change(Update(b.kind, b.labels, item.name, written(rows, "updated")))
        return replace(s, graph=self.graph, variables={**s.variables, item.variable: b})
