"""Property graphs as tables: one DataFrame for each node label and each edge type.

Node tables have ``_id`` and typed property columns; edge tables ``_id``, ``_src``, ``_dst`` and theirs. A graph is
immutable; writes give a new one. The label ``""`` stands for nodes, or edges, without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError

NODE_COLUMNS, EDGE_COLUMNS = ("_id",), ("_id", "_src", "_dst")
NONE = ""
#: Ids are a label's tag and a number below 2**56; tags start at 1, so that no id is 0.
TAG_BITS, MAX_TAG = 56, 127
#: Created nodes and edges are numbered from here; keys of loaded tables lie below.
CREATED = 255 << 48


def kind_of(t: T.DataType) -> str:
    """The query language's type of a column: null, bool, int, float or string."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    raise AnalysisError(f"properties cannot have the type {t.simpleString()}")


SPARK = {"null": "void", "bool": "boolean", "int": "bigint", "float": "double", "string": "string"}


def common_kind(kinds: Iterable[str], what: str) -> str:
    """The one kind of values that are read together: integers and floats meet in float."""
    found = {k for k in kinds if k != "null"}
    if not found:
        return "null"
    if found == {"int", "float"}:
        return "float"
    if len(found) > 1:
        raise AnalysisError(f"{what} has values of several types: {', '.join(sorted(found))}")
    return found.pop()


def packed_id(tag: int, key: Column | str) -> Column:
    """The id of a loaded row. A key that would run into the tag or the created ones stops the job that reads it; a
    null one gives null."""
    number = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("a key of a node or edge is negative or too large: "), number.cast("string")))
    return F.when((number < 0) | (number >= CREATED), wrong).otherwise(number.bitwiseOR(F.lit(tag << TAG_BITS)))


@dataclass(frozen=True)
class Table:
    """The nodes of a label, or the edges of a type."""

    #: The rows, or what gives them when a statement first reads the table.
    source: DataFrame | Callable[[], DataFrame]
    #: Properties that no row lacks; conditions on them need no care for nulls, and are pushed to the scan.
    required: frozenset[str] = frozenset()
    #: Of edges: labels of (source, target) that occur, if known.
    ends: frozenset[tuple[str, str]] | None = None
    #: Writes that have been laid over the stored table.
    depth: int = 0

    @cached_property
    def df(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    def properties(self) -> dict[str, str]:
        return {f.name: kind_of(f.dataType) for f in self.df.schema.fields if f.name not in EDGE_COLUMNS}


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: dict[str, Table] = field(default_factory=dict)
    edges: dict[str, Table] = field(default_factory=dict)
    tags: dict[tuple[str, str], int] = field(default_factory=dict)
    #: Whether every edge's ends are nodes; not so after nodes were deleted.
    whole: bool = True

    # -- what there is

    def tables(self, kind: str) -> dict[str, Table]:
        return self.nodes if kind == "node" else self.edges

    def labels(self, kind: str, label: str | None) -> tuple[str, ...]:
        """The tables that a pattern's label (None: any) reads."""
        known = self.tables(kind)
        return tuple(known) if label is None else (label,) if label in known else ()

    def property_kind(self, kind: str, labels: Iterable[str], name: str) -> str:
        found = [self.tables(kind)[x].properties().get(name, "null") for x in labels]
        return common_kind(found, f"property {name} of {kind}s")

    def property_required(self, kind: str, labels: Iterable[str], name: str) -> bool:
        labels = list(labels)
        return bool(labels) and all(name in self.tables(kind)[x].required for x in labels)

    def property_names(self, kind: str, labels: Iterable[str]) -> list[str]:
        return list(dict.fromkeys(p for x in labels for p in self.tables(kind)[x].properties()))

    def scan(self, kind: str, labels: Iterable[str], names: Iterable[str]) -> DataFrame:
        """Rows of the given tables with ``_label`` and only the properties asked for (null where a label lacks one)."""
        fixed = NODE_COLUMNS if kind == "node" else EDGE_COLUMNS
        labels, names = list(labels), list(names)
        kinds = {n: self.property_kind(kind, labels, n) for n in names}
        parts = []
        for label in labels:
            t = self.tables(kind)[label]
            have = t.properties()
            props = [(F.col(n) if n in have else F.lit(None)).cast(SPARK[kinds[n]]).alias(n) for n in names]
            parts.append(t.df.select(*fixed, F.lit(label or None).cast("string").alias("_label"), *props))
        if not parts:
            schema = ", ".join([f"{c} bigint" for c in fixed] + ["_label string"] + [f"`{n}` void" for n in names])
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # -- new graphs

    def tag(self, kind: str, label: str) -> tuple[PropertyGraph, int]:
        """This graph with a tag for the label, and the tag."""
        if (kind, label) in self.tags:
            return self, self.tags[kind, label]
        used = {t for (k, _), t in self.tags.items() if k == kind}
        tag = next((t for t in range(1, MAX_TAG + 1) if t not in used), None)
        if tag is None:
            raise AnalysisError(f"a graph has no more than {MAX_TAG} labels of {kind}s")
        return replace(self, tags={**self.tags, (kind, label): tag}), tag

    def with_table(self, kind: str, label: str, t: Table) -> PropertyGraph:
        if kind == "node":
            return replace(self, nodes={**self.nodes, label: t})
        return replace(self, edges={**self.edges, label: t})

    def add_nodes(self, label: str, df: DataFrame | Callable[[], DataFrame], key: str, required: Iterable[str] = ()) -> PropertyGraph:
        """A table of nodes, whose ids are made of the integer column ``key``; ``df`` may be a function that gives it."""
        g, tag = self.tag("node", label)

        def rows() -> DataFrame:
            own = Table(df).df
            return own.select(packed_id(tag, key).alias("_id"), *(c for c in own.columns if c != key))

        return g.with_table("node", label, Table(rows, frozenset(required)))

    def add_edges(self, label: str, df: DataFrame | Callable[[], DataFrame], source: tuple[str, str], target: tuple[str, str], key: str, required: Iterable[str] = ()) -> PropertyGraph:
        """A table of edges; ``source`` and ``target`` are (label, column with its key). Adds to a type that is there."""
        g, tag = self.tag("edge", label)
        tags = [g.tags["node", x] for x, _ in (source, target)]

        def rows() -> DataFrame:
            own = Table(df).df
            ids = [packed_id(t, c).alias(out) for t, c, out in ((tag, key, "_id"), (tags[0], source[1], "_src"), (tags[1], target[1], "_dst"))]
            return own.select(*ids, *(c for c in own.columns if c not in (key, source[1], target[1])))

        ends = frozenset({(source[0], target[0])})
        if label in g.edges:
            old = g.edges[label]
            both = Table(lambda: old.df.unionByName(rows(), allowMissingColumns=True), old.required & frozenset(required), None if old.ends is None else old.ends | ends)
            return g.with_table("edge", label, both)
        return g.with_table("edge", label, Table(rows, frozenset(required), ends))
