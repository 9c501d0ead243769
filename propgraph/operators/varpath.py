"""Variable-length paths: breadth-first reachability from many roots at once.

Every node that a root reaches is found once, at its least depth. There are two ways, with the same result:

``swept``: up to ``EDGES`` edges are broadcast as arrays, and each task searches from ``ROOTS`` roots together. A node
has one bit for each of them, so that a level is one OR over the edges for all of a task's roots; nothing is shuffled,
and no pair of a root and a node is kept. Pairs come as blocks, an array of nodes with that of the roots that reach them
all, and are taken apart where they are used, node by node: one column stays the same while the other goes through the
same roots again, which Parquet keeps in little space. Where rows of roots are too many
to be broadcast, pairs come as arrays of nodes for one root, to be shuffled by it.

``levels``: for any number of edges, and for paths of up to ``SHORT`` hops, which reach few nodes. Each level is one join of the frontier with the edges and one anti join with what
was visited, both by shuffle on their keys or by broadcast as sizes allow; levels are written tables, so that no plan
grows and lost executors cost a level at most.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Hops
from ..sources.shared import written

#: Hops of a path whose length is left open.
OPEN = 20
#: Edges that are broadcast: 4 bytes each, and 12 a node; the driver reads them with 16.
EDGES = 4_000_000
#: Roots that a task searches from together, a multiple of 64: as many bits a node. With 256, a file that a task writes
#: needs one byte for each of them, so that what comes again is found again wherever it begins. A task gets ``DEALT`` on
#: average, a few less, as ranges are not quite even.
ROOTS, DEALT = 256, 240
#: Words of 64 bits that a task holds for all edges at once; with more, its roots go in turns.
WORDS = 1 << 23
#: Pairs in one row, which Spark holds at once when it takes them apart. Ids in an Arrow batch, about.
NODES, BATCH = 1 << 13, 1 << 20
#: Values (rows times columns) that are broadcast to joins with pairs.
VALUES = 4_000_000
#: Paths of up to so many hops go level by level.
SHORT = 3


@dataclass(frozen=True)
class Reached:
    """What roots reach: ``pairs`` (root, nodes: an array)."""

    pairs: Callable[[], DataFrame]
    #: The same as (roots, nodes): arrays, each root with each node; None if there is no such form.
    blocks: Callable[[], DataFrame] | None = None
    #: The ids that can be in ``nodes``, (node), and how many they are at most; None if that is not known.
    few: DataFrame | None = None
    count: int = 0

    def among(self, nodes: DataFrame, at: str) -> DataFrame:
        """Those of ``nodes`` (with an id in the column ``at``) that pairs can lead to, to be broadcast if they are few."""
        if self.few is None or self.count * len(nodes.columns) > VALUES:
            return nodes
        return F.broadcast(nodes.join(self.few, F.col(f"`{at}`") == self.few["node"], "left_semi"))

    def join(self, df: DataFrame, at: str, out: str, rows: int) -> DataFrame:
        """``df``, of ``rows`` rows, with a row for each node that the id in the column ``at`` reaches, as ``out``."""
        fits = rows * len(df.columns) <= VALUES
        df = F.broadcast(df) if fits else df
        if fits and self.blocks is not None:
            blocks = self.blocks().withColumnsRenamed({"roots": "<roots>", "nodes": "<nodes>"})
            pairs = blocks.withColumn(out, F.explode("<nodes>")).drop("<nodes>").withColumn("<root>", F.explode("<roots>")).drop("<roots>")
            return pairs.join(df, F.col("`<root>`") == F.col(f"`{at}`")).drop("<root>")
        pairs = self.pairs().withColumnsRenamed({"root": "<root>", "nodes": "<nodes>"})
        return pairs.join(df, F.col("`<root>`") == F.col(f"`{at}`")).withColumn(out, F.explode("<nodes>")).drop("<root>", "<nodes>")


def reach(roots: DataFrame, edges: DataFrame, hops: Hops) -> Reached:
    """Nodes with least depth in ``hops``, from ``roots`` (root, distinct, a written table) over ``edges`` (near, far).

    The root itself counts only at depth 0; no cycle leads back to it.
    """
    most = OPEN if hops.most is None else hops.most
    edges = edges.distinct()  # parallel edges reach no more
    if most > 1:
        edges = written(edges, "path-edges")
    if most > SHORT and edges.count() <= EDGES:
        try:
            return swept(roots, edges, hops.least, most)
        except ImportError:
            pass  # no NumPy or Arrow here
    found = levels(roots, edges, hops.least, most)
    return Reached(lambda: found.select("root", F.array("node").alias("nodes")))


def levels(roots: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """(root, node), level by level."""
    visited = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "paths")
    frontier = visited
    for depth in range(1, most + 1):
        step = frontier.join(edges, frontier["node"] == edges["near"]).select("root", F.col("far").alias("node")).distinct()
        new = step.join(visited.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(new, "paths")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.filter(F.col("depth").between(least, most)).select("root", "node")


def swept(roots: DataFrame, edges: DataFrame, least: int, most: int) -> Reached:
    """Tasks of neighbouring roots, each with all edges."""
    import numpy as np
    import pyarrow  # noqa: F401

    t = edges.toArrow()
    near, far = (np.asarray(t[x].to_numpy(), "int64") for x in ("near", "far"))
    ids = np.unique(np.concatenate([near, far]))
    near, far = np.searchsorted(ids, near), np.searchsorted(ids, far).astype("int32")
    first = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=len(ids)))]).astype("int32")
    graph = roots.sparkSession.sparkContext.broadcast((ids, first, far[np.argsort(near, kind="stable")]))
    count = roots.count()

    def found(schema: str, blocks: bool) -> DataFrame:
        parts = roots.repartitionByRange(max(1, -(-count // DEALT)), "root")
        return _of_unknown_size(parts.mapInArrow(_search(graph, least, most, blocks), schema))

    few = edges.select(F.col("far").alias("node"))
    if least == 0:
        few = few.unionByName(roots.select(F.col("root").alias("node")))
    pairs, blocks = (lambda: found("root long, nodes array<long>", False)), (lambda: found("roots array<long>, nodes array<long>", True))
    return Reached(pairs, blocks, few.distinct(), len(ids) + (count if least == 0 else 0))


def _of_unknown_size(df: DataFrame) -> DataFrame:
    """``df`` without an estimate of its size, which would be that of the roots: no join broadcasts it."""
    spark = df.sparkSession
    jdf = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(jdf, spark)


def _search(graph, least: int, most: int, blocks: bool = False) -> Callable[[Iterator], Iterator]:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        roots = [np.asarray(b.column(0).to_numpy(zero_copy_only=False), "int64") for b in batches]
        roots = np.concatenate([np.zeros(0, "int64"), *roots])
        for i in range(0, len(roots), ROOTS):
            yield from sweep(*graph.value, roots[i : i + ROOTS], least, most, blocks)

    return run


def sweep(ids, first, far, roots, least: int, most: int, blocks: bool = False) -> Iterator:
    """Arrow batches (root, nodes) of distinct roots, or (roots, nodes) as ``blocks``. ``ids`` ascend; the edges of the
    k-th lead to the places ``far[first[k] : first[k + 1]]`` in them."""
    import numpy as np

    def edges(nodes):
        """Edges of nodes, as places in ``nodes`` and in ``far``."""
        n = first[nodes + 1] - first[nodes]
        which = np.repeat(np.arange(len(nodes)), n)
        return which, np.arange(len(which)) + (first[nodes] - (np.cumsum(n) - n))[which]

    at = np.minimum(np.searchsorted(ids, roots), max(len(ids) - 1, 0))
    known = np.flatnonzero(ids[at] == roots) if len(ids) else np.zeros(0, "int64")  # the others have no edges
    # the part of the graph that any of the roots reaches
    inside = np.zeros(len(ids), bool)
    new = at[known]
    inside[new] = True
    for _ in range(most):
        new = far[edges(new)[1]]
        new = np.unique(new[~inside[new]])
        if not len(new):
            break
        inside[new] = True
    here = np.flatnonzero(inside)
    place = np.cumsum(inside) - 1
    source, target = edges(here)
    keep = inside[far[target]]
    source, target = source[keep], place[far[target[keep]]]
    order = np.argsort(target, kind="stable")
    source = source[order]
    ends, start = np.unique(target[order], return_index=True)

    start_at = np.full(len(roots), -1)
    start_at[known] = place[at[known]]
    width = 64 * max(1, WORDS // max(len(source), len(here), 1))
    for i in range(0, len(roots), width):
        part = start_at[i : i + width]
        there = np.flatnonzero(part >= 0)
        level = np.zeros((len(here), -(-len(part) // 64)), "uint64")  # one bit a root
        level[part[there], there // 64] = np.uint64(1) << (there % 64).astype("uint64")
        visited, found = level.copy(), np.zeros_like(level)
        for depth in range(1, most + 1):
            if not len(source):
                break
            new = np.bitwise_or.reduceat(level[source], start, axis=0) & ~visited[ends]
            if not new.any():
                break
            visited[ends] |= new
            level[:] = 0
            level[ends] = new
            if depth >= least:
                found[ends] |= new
        yield from (_blocks if blocks else _rows)(ids[here], found, roots[i : i + width], least == 0)


def _rows(ids, found, roots, own: bool) -> Iterator:
    """A row for each root and up to ``NODES`` of the nodes with its bit; before them the root itself, if ``own``."""
    import numpy as np
    import pyarrow as pa

    def batch():
        offsets = np.cumsum([0, *map(len, lists)]).astype("int32")
        nodes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, "int64")), nodes], ["root", "nodes"])

    keys, lists, size = [], [], 0
    for k, root in enumerate(roots):
        if k % 64 == 0:
            word = np.ascontiguousarray(found[:, k // 64]).astype("<u8", copy=False)
            bits = np.unpackbits(word.view("uint8").reshape(-1, 8), axis=1, bitorder="little").T
            bits = np.ascontiguousarray(bits).view(bool)
        nodes = ids[np.flatnonzero(bits[k % 64])]
        if own:
            nodes = np.concatenate([[root], nodes])
        for i in range(0, len(nodes), NODES):
            keys.append(root)
            lists.append(nodes[i : i + NODES])
        size += len(nodes)
        if size >= BATCH:
            yield batch()
            keys, lists, size = [], [], 0
    if keys:
        yield batch()


def _blocks(ids, found, roots, own: bool) -> Iterator:
    """A row for nodes with the same bits and up to ``NODES`` of their pairs with roots; before them each root with itself,
    if ``own``."""
    import numpy as np
    import pyarrow as pa

    def lists(offsets, values):
        return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(values))

    if own:
        one = lists(np.arange(len(roots) + 1), roots)
        yield pa.RecordBatch.from_arrays([one, one], ["roots", "nodes"])
    order = np.lexsort(found.T)
    order = order[found[order].any(axis=1)]
    if not len(order):
        return
    ids, found = ids[order], found[order]
    start = np.concatenate([[0], np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1])
    end = np.append(start[1:], len(ids))
    kinds = np.ascontiguousarray(found[start]).astype("<u8", copy=False).view("uint8")  # of nodes, by their bits
    ones = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1).sum(axis=1, dtype="uint8")
    most = np.maximum(1, NODES // ones[kinds].sum(axis=1, dtype="int64"))
    rows = -(-(end - start) // most)
    kind = np.repeat(np.arange(len(rows)), rows)
    start = start[kind] + (np.arange(len(kind)) - np.repeat(np.cumsum(rows) - rows, rows)) * most[kind]
    start = np.append(start, len(ids))  # each row ends where the next begins
    step = max(1, BATCH // len(roots))
    for i in range(0, len(kind), step):
        bits = np.unpackbits(kinds[kind[i : i + step]], axis=1, bitorder="little")
        at = start[i : i + step + 1]
        these = lists(np.append(0, np.cumsum(bits.sum(axis=1, dtype="int64"))), roots[np.nonzero(bits)[1]])
        yield pa.RecordBatch.from_arrays([these, lists(at - at[0], ids[at[0] : at[-1]])], ["roots", "nodes"])
