"""Connected components of a link table, by alternating stars: no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROWS_A_FILE = 500_000
#: A node with more links than this is a hub, or with more than a share of 1 / MOST_HUBS of all, if that is more.
HUB_ROWS, MOST_HUBS = 500_000, 10_000


def _join_hubs(both: DataFrame, least: DataFrame, rows: int | None) -> DataFrame:
    """``both`` joined to ``least`` on a. Nodes with so many rows that one task would feel it (at most MOST_HUBS) are
    broadcast; the others are shuffled."""
    rows = both.count() if rows is None else rows
    if rows <= HUB_ROWS:
        return both.join(least.drop("n"), "a")
    hubs = least.filter(F.col("n") > max(HUB_ROWS, rows // MOST_HUBS)).drop("n")
    of_hubs = both.join(F.broadcast(hubs), "a")
    return both.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.drop("n"), "a").unionByName(of_hubs)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of ``links`` (a long, b long); a component's id is its smallest node. Nodes without links are left out.

    Each round hangs larger neighbours on the smallest one known (large star), then smaller ones (small star), as
    written tables; it ends when a round changes nothing, after a number of rounds that grows with the logarithm of
    the component's size.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _join_hubs(both, least, 2 * state[0] if state else None).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = small.select("e.a", "e.b").filter("a <> b").distinct()
        if state:
            after = after.coalesce(3 + state[0] // ROWS_A_FILE)  # links do not become more: as many files as they need
        edges = written(after, "star")
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
