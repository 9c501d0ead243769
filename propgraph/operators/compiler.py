"""Statements to DataFrames.

Bindings are flat columns: a variable's id, label and the properties that the statement reads, so that column pruning
and filter push-down work as for any other query. A pattern that shares a variable with what is bound starts there;
otherwise it is a product with it, and conditions that link both become join keys. Conditions of WHERE are applied as
soon as their variables are bound, which matters in front of variable-length paths: these run jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from itertools import dropwhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions.expr import Compiler, Typed, aggregate, is_aggregate, null
from ..plans import ast as A
from ..sources.catalog import PropertyGraph
from ..sources.shared import written
from .varpath import Reached, reach


#: How many equal bindings a row stands for.
TIMES = "<times>"


@dataclass(frozen=True)
class Binding:
    """A variable: the prefix of its columns, and the labels that it can have."""

    kind: str
    prefix: str
    labels: tuple[str, ...]
    names: tuple[str, ...]  # properties that are there as columns
    #: Whether the entity may be missing: the far end of an edge whose node was deleted.
    dangling: bool = False

    def col(self, name: str) -> Column:
        return F.col(f"`{self.prefix}#{name}`")

    def prop(self, name: str) -> Column:
        return F.col(f"`{self.prefix}.{name}`")

    @property
    def id(self) -> Column:
        return self.col("id")

    @property
    def fixed(self) -> tuple[str, ...]:
        return ("id", "label") if self.kind == "node" else ("id", "label", "src", "dst")


@dataclass
class Needs:
    """What a statement reads of each variable."""

    properties: dict[str, set[str]] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, s: A.Statement) -> Needs:
        n = cls()
        for x in A.walk(s.steps) if s.steps else ():
            if isinstance(x, (A.NodePattern, A.EdgePattern)) and x.variable:
                n.properties.setdefault(x.variable, set()).update(k for k, _ in x.properties)
            elif isinstance(x, A.SetItem):
                n.properties.setdefault(x.variable, set()).add(x.name)
        for x in A.walk([s.steps, s.returns, s.order]):
            if isinstance(x, A.Property) and isinstance(x.of, A.Variable):
                n.properties.setdefault(x.of.name, set()).add(x.name)
        if s.returns is None:
            n.whole = {v.variable for v in A.walk(s.steps) if isinstance(v, (A.NodePattern, A.EdgePattern)) and v.variable}
        for item in s.returns or ():
            if isinstance(item.expr, A.Variable):
                n.whole.add(item.expr.name)
        return n


@dataclass
class Bindings:
    """The rows so far (None: no clause has given any) and what their columns are. A scope for expressions."""

    graph: PropertyGraph
    df: DataFrame | None = None
    variables: dict[str, Binding] = field(default_factory=dict)
    #: Properties that a SET gave a kind of its own: (variable, name) -> kind
    kinds: dict[tuple[str, str], str] = field(default_factory=dict)
    #: Whether a row stands for as many as its column TIMES says.
    merged: bool = False

    def binding(self, name: str) -> Binding:
        if name not in self.variables:
            raise AnalysisError(f"the variable {name} is not bound")
        return self.variables[name]

    def variable(self, name: str) -> Typed:
        b = self.binding(name)
        fields = {x: b.col(x) for x in b.fixed}
        props = [b.prop(p).alias(p) for p in b.names]
        inner = F.struct(*(c.alias(f"_{x}") for x, c in fields.items()), *props)
        return Typed(inner, b.kind, nullable=False, fields=fields)

    def property(self, name: str, key: str) -> Typed:
        b = self.binding(name)
        kind = self.kinds.get((name, key)) or self.graph.property_kind(b.kind, b.labels, key)
        if kind == "null" or key not in b.names:
            return null()
        sure = (name, key) not in self.kinds and not b.dangling and self.graph.property_required(b.kind, b.labels, key)
        return Typed(b.prop(key), kind, nullable=not sure)


class Planner:
    def __init__(self, graph: PropertyGraph, statement: A.Statement):
        self.graph, self.statement, self.needs = graph, statement, Needs.of(statement)
        self.counter = 0
        #: Conjuncts of WHERE that wait until all of their variables are bound.
        self.waiting: list[A.Expr] = []
        #: Patterns and clauses after the path that is being matched.
        self.ahead: list = []
        returns = () if statement.writes or statement.order or statement.skip or statement.limit is not None else statement.returns or ()
        self.counts = bool(returns) and all(isinstance(r.expr, A.Call) and r.expr.name.lower() == "count" for r in returns)

    # -- names and tables

    def prefix(self) -> str:
        self.counter += 1
        return f"v{self.counter}"

    def wanted(self, kind: str, variable: str | None, labels: Iterable[str], extra: Iterable[str] = ()) -> tuple[str, ...]:
        if variable in self.needs.whole:
            return tuple(self.graph.property_names(kind, labels))
        asked = set(extra) | (self.needs.properties.get(variable, set()) if variable else set())
        there = set(self.graph.property_names(kind, labels))
        return tuple(sorted(asked & there))

    def bind(self, kind: str, variable: str | None, labels: tuple[str, ...], extra: Iterable[str] = ()) -> Binding:
        return Binding(kind, self.prefix(), labels, self.wanted(kind, variable, labels, extra))

    def table(self, b: Binding) -> DataFrame:
        df = self.graph.scan(b.kind, b.labels, b.names)
        return df.select(*(F.col(f"_{x}").alias(f"{b.prefix}#{x}") for x in b.fixed), *(F.col(f"`{p}`").alias(f"{b.prefix}.{p}") for p in b.names))

    # -- conditions

    def filter(self, s: Bindings, *conditions: A.Expr) -> Bindings:
        c = Compiler(s)
        df = s.df
        for e in conditions:
            df = df.filter(c.condition(e))
        return replace(s, df=df)

    def settle(self, s: Bindings) -> Bindings:
        """Applies the waiting conditions whose variables are all bound."""
        ready = [e for e in self.waiting if A.variables(e) <= set(s.variables)]
        self.waiting = [e for e in self.waiting if e not in ready]
        return self.filter(s, *ready) if ready else s

    @staticmethod
    def equalities(variable: str, properties: tuple[tuple[str, A.Expr], ...]) -> list[A.Expr]:
        return [A.Binary("=", A.Property(A.Variable(variable), k), v) for k, v in properties]

    def narrow(self, s: Bindings, name: str, p: A.NodePattern) -> Bindings:
        """A label and properties that a pattern asks of a node that is bound."""
        b = s.variables[name]
        if p.label is not None:
            s = replace(s, df=s.df.filter(b.col("label") == F.lit(p.label)))
            s = replace(s, variables={**s.variables, name: replace(b, labels=tuple(x for x in b.labels if x == p.label))})
        self.waiting += self.equalities(name, p.properties)
        return self.settle(s)

    # -- MATCH

    def match(self, s: Bindings, clause: A.Match, where: list[A.Expr]) -> Bindings:
        self.waiting += where
        after = self.statement.steps[next(k for k, x in enumerate(self.statement.steps) if x is clause) + 1 :]
        after = list(dropwhile(lambda x: isinstance(x, A.Where), after))
        for k, path in enumerate(clause.paths):
            self.ahead = [clause.paths[k + 1 :], after]
            s = self.path(s, path)
        if self.waiting:
            missing = sorted(set().union(*map(A.variables, self.waiting)) - set(s.variables))
            raise AnalysisError(f"the variable {', '.join(missing)} is not bound")
        return s

    def path(self, s: Bindings, path: A.Path) -> Bindings:
        names = [n.variable or f"<{self.prefix()}>" for n in path.nodes]
        known = next((k for k, n in enumerate(names) if n in s.variables), None)
        if known is None and s.df is None and self.on_edges(path):
            s = self.first_hop(s, names[0], path.nodes[0], path.edges[0], names[1], path.nodes[1])
            for k in range(1, len(path.edges)):
                s = self.merge(s, names[k], (path.edges[k:], path.nodes[k + 1 :]))
                s = self.hop(s, names[k], path.edges[k], names[k + 1], path.nodes[k + 1])
            return s
        if known is None:
            own = self.start(Bindings(self.graph), names[0], path.nodes[0])
            s = own if s.df is None else replace(s, df=s.df.crossJoin(own.df), variables={**s.variables, **own.variables})
            s = self.settle(s)
            known = 0
        else:
            if s.variables[names[known]].kind != "node":
                raise AnalysisError(f"the variable {names[known]} is an edge")
            s = self.narrow(s, names[known], path.nodes[known])
        before = (path.edges[:known], path.nodes[: known + 1]) if known else ()
        for k in range(known, len(path.edges)):
            s = self.merge(s, names[k], (path.edges[k:], path.nodes[k + 1 :], before))
            s = self.hop(s, names[k], path.edges[k], names[k + 1], path.nodes[k + 1])
        for k in range(known - 1, -1, -1):
            e = path.edges[k]
            s = self.merge(s, names[k + 1], (path.edges[: k + 1], path.nodes[: k + 1]))
            back = {"out": "in", "in": "out", "any": "any"}[e.direction]
            s = self.hop(s, names[k + 1], replace(e, direction=back), names[k], path.nodes[k])
        return s

    def merge(self, s: Bindings, near: str, rest: object) -> Bindings:
        """Before a hop from ``near``, in a statement that only counts: one row for each of its nodes, where nothing else
        that is bound is read later, so that the hop gives a row for each edge at most, and no pairs of those that meet
        in a node. ``rest`` is what comes in the same path."""
        if not self.counts or set(s.variables) == {near}:
            return s
        read = set()
        for x in A.walk([rest, self.ahead, self.waiting, self.statement.returns]):
            if isinstance(x, A.Variable):
                read.add(x.name)
            elif isinstance(x, (A.NodePattern, A.EdgePattern)):
                read.add(x.variable)
        b = s.variables[near]
        own = [f for f in s.df.schema.fields if f.name.startswith((f"{b.prefix}#", f"{b.prefix}."))]
        # grouping changes -0.0
        if (read & s.variables.keys()) - {near} or any(f.dataType.simpleString() not in ("bigint", "int", "string", "boolean") for f in own):
            return s
        times = F.sum(F.col(f"`{TIMES}`")) if s.merged else F.count(F.lit(1))
        return replace(s, df=s.df.groupBy(*(F.col(f"`{f.name}`") for f in own)).agg(times.alias(TIMES)), variables={near: b}, merged=True)

    def start(self, s: Bindings, name: str, p: A.NodePattern) -> Bindings:
        b = self.bind("node", p.variable, self.graph.labels("node", p.label), (k for k, _ in p.properties))
        s = replace(s, df=self.table(b), variables={name: b})
        self.waiting += self.equalities(name, p.properties)
        return self.settle(s)

    def on_edges(self, path: A.Path) -> bool:
        """Whether a path can begin with its first edge's table: what is read of the first node is in the edges' ends."""
        if not path.edges or path.edges[0].hops is not None or not self.graph.whole:
            return False
        p, e = path.nodes[0], path.edges[0]
        types = self.graph.labels("edge", e.label)
        back = {"out": "in", "in": "out", "any": "any"}[e.direction]
        ends = self.far_labels(types, back, tuple(self.graph.nodes))
        labels = self.graph.labels("node", p.label)
        if ends is None or len(ends) != 1 or ends[0] not in labels:
            return False
        return p.variable != path.nodes[1].variable and not self.wanted("node", p.variable, labels, (k for k, _ in p.properties)) and not p.properties

    def first_hop(self, s: Bindings, near: str, p: A.NodePattern, e: A.EdgePattern, far: str, q: A.NodePattern) -> Bindings:
        types = self.graph.labels("edge", e.label)
        back = {"out": "in", "in": "out", "any": "any"}[e.direction]
        a = Binding("node", self.prefix(), self.far_labels(types, back, tuple(self.graph.nodes)), ())
        label = F.lit(a.labels[0] or None).cast("string")
        return self.along(replace(s, variables={near: a}), a, e, types, far, q, lambda edges, eb: edges.withColumn(f"{a.prefix}#id", eb.col("near")).withColumn(f"{a.prefix}#label", label))

    def far_labels(self, edges: tuple[str, ...], direction: str, near: tuple[str, ...]) -> tuple[str, ...] | None:
        """Labels that the far ends of edges can have; None if that is not known."""
        out: dict[str, None] = {}
        for x in edges:
            ends = self.graph.edges[x].ends
            if ends is None:
                return None
            for src, dst in sorted(ends):
                if direction in ("out", "any") and src in near:
                    out[dst] = None
                if direction in ("in", "any") and dst in near:
                    out[src] = None
        return tuple(out)

    def oriented(self, b: Binding, direction: str) -> DataFrame:
        """Edges with ``near`` and ``far`` columns, each as often as it can be walked."""
        t = self.table(b)
        near, far = f"{b.prefix}#near", f"{b.prefix}#far"
        if direction == "any":
            # both ways from one reading of the table
            ways = F.array(*(F.struct(b.col(x).alias("n"), b.col(y).alias("f")) for x, y in (("src", "dst"), ("dst", "src"))))
            both = t.withColumn("<way>", F.explode(ways))
            return both.withColumn(near, F.col("`<way>`.n")).withColumn(far, F.col("`<way>`.f")).drop("<way>")
        x, y = ("src", "dst") if direction == "out" else ("dst", "src")
        return t.withColumn(near, b.col(x)).withColumn(far, b.col(y))

    def hop(self, s: Bindings, near: str, e: A.EdgePattern, far: str, p: A.NodePattern) -> Bindings:
        a = s.variables[near]
        if a.dangling:
            s = replace(s, df=s.df.filter(a.col("live")))  # a node that is gone has no edges
        types = self.graph.labels("edge", e.label)
        if e.hops is not None:
            return self.walk(s, a, e, types, far, p)
        return self.along(s, a, e, types, far, p, lambda edges, eb: s.df.join(edges, a.id == eb.col("near")))

    def along(self, s: Bindings, a: Binding, e: A.EdgePattern, types: tuple[str, ...], far: str, p: A.NodePattern, attach: Callable[[DataFrame, Binding], DataFrame]) -> Bindings:
        """Binds an edge and its far node; ``attach`` puts the edges to what is bound."""
        eb = self.bind("edge", e.variable, types, (k for k, _ in e.properties))
        name = e.variable or f"<{eb.prefix}>"
        if name in s.variables:
            raise AnalysisError(f"the variable {name} is bound already")
        df = attach(self.oriented(eb, e.direction), eb).drop(f"{eb.prefix}#near")
        s = replace(s, df=df, variables={**s.variables, name: eb})
        self.waiting += self.equalities(name, e.properties)
        s = self.settle(s)
        s = self.arrive(s, f"{eb.prefix}#far", far, p, self.far_labels(types, e.direction, a.labels))
        return replace(s, df=s.df.drop(f"{eb.prefix}#far"))

    def walk(self, s: Bindings, a: Binding, e: A.EdgePattern, types: tuple[str, ...], far: str, p: A.NodePattern) -> Bindings:
        if e.variable or e.properties:
            raise AnalysisError("an edge with a quantifier has no variable and no properties")
        edges = self.oriented(Binding("edge", "e", types, ()), e.direction).select(F.col("`e#near`").alias("near"), F.col("`e#far`").alias("far"))
        if not self.graph.whole:
            # edges lead on from nodes that are there
            edges = edges.join(self.graph.scan("node", tuple(self.graph.nodes), ()).select(F.col("_id").alias("near")), "near", "left_semi")
        x = self.prefix()
        roots = written(s.df.groupBy(a.id.alias("root")).agg(F.count(F.lit(1)).alias("rows")), "paths")
        rows = roots.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        found = reach(roots.select("root"), edges, e.hops)
        s = replace(s, df=found.join(s.df, f"{a.prefix}#id", f"{x}#far", rows))
        s = self.arrive(s, f"{x}#far", far, p, self.reached_labels(types, e, a.labels), found)
        return replace(s, df=s.df.drop(f"{x}#far"))

    def reached_labels(self, types: tuple[str, ...], e: A.EdgePattern, near: tuple[str, ...]) -> tuple[str, ...] | None:
        """Labels of the nodes that paths can end at; None if that is not known."""
        out: tuple[str, ...] = ()
        while True:
            more = self.far_labels(types, e.direction, (*near, *out))
            if more is None:
                return None
            if set(more) <= set(out):
                return tuple(dict.fromkeys((*near, *out))) if e.hops.least == 0 else out
            out = more

    def arrive(self, s: Bindings, at: str, far: str, p: A.NodePattern, possible: tuple[str, ...] | None, found: Reached | None = None) -> Bindings:
        """Binds the node whose id is in the column ``at``."""
        if far in s.variables:
            s = replace(s, df=s.df.filter(F.col(f"`{at}`") == s.variables[far].id))
            return self.narrow(s, far, p)
        labels = self.graph.labels("node", p.label)
        if possible is not None:
            labels = tuple(x for x in labels if x in possible)
        b = self.bind("node", p.variable, labels, (k for k, _ in p.properties))

        def nodes() -> DataFrame:
            return self.table(b) if found is None else found.among(self.table(b), f"{b.prefix}#id")

        if self.graph.whole and possible is not None and set(possible) <= set(labels) and not b.names and len(labels) <= 1:
            # the edges' ends say all there is to know: no join
            label = F.lit((labels[0] or None) if labels else None).cast("string")
            df = s.df.withColumn(f"{b.prefix}#id", F.col(f"`{at}`")).withColumn(f"{b.prefix}#label", label)
        elif self.graph.whole or p.label is not None:
            df = s.df.join(nodes(), F.col(f"`{at}`") == b.id)
        else:
            b = replace(b, dangling=True)
            live = nodes().withColumn(f"{b.prefix}#live", F.lit(True))
            df = s.df.join(live, F.col(f"`{at}`") == b.id, "left")
            df = df.withColumn(f"{b.prefix}#live", F.coalesce(b.col("live"), F.lit(False))).withColumn(f"{b.prefix}#id", F.col(f"`{at}`"))
        s = replace(s, df=df, variables={**s.variables, far: b})
        self.waiting += self.equalities(far, p.properties)
        return self.settle(s)

    # -- the end of a statement

    def finish(self, s: Bindings) -> DataFrame:
        """ORDER BY, SKIP and LIMIT on the bindings, then RETURN."""
        q = self.statement
        if s.df is None:
            if q.returns is None:
                raise AnalysisError("the statement reads and gives nothing")
            s = replace(s, df=self.graph.spark.range(1).select(F.lit(True).alias("<one>")))
        keys = self.sort_keys(s)
        df = s.df
        if keys:
            df = df.orderBy(*keys)
        if q.skip:
            df = df.offset(q.skip)
        if q.limit is not None:
            df = df.limit(q.limit)
        return self.project(replace(s, df=df), keys)

    def sort_keys(self, s: Bindings) -> list[Column]:
        aliases = {r.alias: r.expr for r in self.statement.returns or () if r.alias}
        out = []
        for o in self.statement.order:
            e = o.expr
            if isinstance(e, A.Variable) and e.name not in s.variables and e.name in aliases:
                e = aliases[e.name]
                if is_aggregate(e):
                    continue  # of one row there is no order
            x = Compiler(s, tolerant=True).value(e)
            c = x.fields["id"] if x.fields else x.col
            if x.kind != "null":
                out.append(c.desc_nulls_last() if o.descending else c.asc_nulls_first())
        return out

    def project(self, s: Bindings, keys: list[Column]) -> DataFrame:
        items = self.statement.returns
        if items is None:
            items = tuple(A.ReturnItem(A.Variable(v), None) for v in s.variables if not v.startswith("<"))
        names = _unique([r.alias or A.text(r.expr) for r in items])
        kinds = [is_aggregate(r.expr) for r in items]
        if any(kinds):
            if not all(kinds):
                raise AnalysisError("aggregates and other expressions together need GROUP BY, which the language does not have")
            return s.df.agg(*(aggregate(r.expr, s, F.col(f"`{TIMES}`") if s.merged else None).alias(f"c{k}") for k, r in enumerate(items))).toDF(*names)
        c = Compiler(s)
        cols = [c.value(r.expr).col.alias(f"c{k}") for k, r in enumerate(items)]
        if not self.statement.distinct:
            return s.df.select(*cols).toDF(*names)
        return self.distinct(s, cols, keys).toDF(*names)

    def distinct(self, s: Bindings, cols: list[Column], keys: list[Column]) -> DataFrame:
        """Distinct rows, in the order of the first one of each. The window's limit of one is applied in each task
        before rows are shuffled, so that a value with many rows is not one task's work."""
        if not keys:
            return s.df.select(*cols).dropDuplicates()
        own = [f"c{k}" for k in range(len(cols))]
        rows = s.df.select("*", *cols)
        first = rows.withColumn("<first>", F.row_number().over(Window.partitionBy(*own).orderBy(*keys))).filter(F.col("<first>") == 1)
        return first.orderBy(*keys).select(*own)


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        k, x = 2, n
        while x in out:
            x, k = f"{n}_{k}", k + 1
        out.append(x)
    return out
