"""Sharding by longest-processing-time scheduling.

Rows that must stay together (equal texts) form a group; groups, sorted by size, go one after the other to the
shard with the least load, which a heap gives. The law is ``bytes``: shard sizes come near equal, as far as single
groups allow.

Scale: to the schedule, groups of one size are alike, so that the driver needs the histogram (size, number of groups)
alone. Its sizes are different numbers whose sum is at most that of all bytes, so there are no more of them than the
root of twice these bytes. A size's groups go to the heap one by one while shards are uneven; where loads lie closer
than the size, each round gives every shard one group, and the remaining rounds are counted at once. Either way the
result is what the heap gives for all groups. The groups of a size then find their shards by their rank in the whole
order of sizes, which comes from a range partitioning: no size, however common, is one task. Group sizes are partial
aggregates; groups with many rows (at most ``MOST_HOT``) are broadcast to them, the others joined. Slots are numbered
in slices of each shard, and the slices' offsets are added; rows that are repeated lie in different slices.

Defined results: a null text counts as an empty one (size 8, group of the empty text); null ids are rows as others
are; repeated rows share a group and have slots of their own; an empty table gives an empty result; input columns
that have a result's name are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, held, lookup

SHARDS, FIXED_BYTES = 24, 8
#: A group with more rows than this is broadcast to them, or with more than a share of 1 / MOST_HOT of all, if that is more.
HOT_ROWS, MOST_HOT = 50_000, 10_000
#: A shard's rows are numbered in so many slices at least, and in more where a slice would have more rows than this.
SLICES, SLICE_ROWS = 64, 1_000_000


def lpt(histogram: list[tuple[int, int]], shards: int) -> np.ndarray:
    """How many groups of each size go to each shard, from (size, groups), sizes descending: what a heap gives that
    takes the groups one by one, each to the least-loaded shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = np.zeros((len(histogram), shards), np.int64)
    for row, (size, n) in zip(out, histogram, strict=True):
        while n:
            if n >= shards and max(heap)[0] - heap[0][0] < size:
                # loads differ by less than the size: every round gives each shard one group, in the same order
                rounds = n // shards
                row += rounds
                heap = [(load + rounds * size, s) for load, s in heap]
                n -= rounds * shards
                continue
            load, s = heap[0]
            # as many in a row as leave the shard in front of the next
            after = min(heap[1:3]) if shards > 1 else (float("inf"), 0)
            times = min(n, max(1, -(-(after[0] - load) // size))) if size and shards > 1 else n
            row[s] += times
            heapq.heapreplace(heap, (load + times * size, s))
            n -= times
    return out


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (with group string, size; read three times) with ``shard``."""
    spark = rows.sparkSession
    groups = held(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    count, total = groups.agg(F.count(F.lit(1)), F.sum("rows")).first()
    histogram = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).collect()]
    upto = np.cumsum(lpt(histogram, shards), axis=1)  # the places at which a size's groups change their shard
    first = np.cumsum([0, *(n for _, n in histogram)], dtype=np.int64)[:-1]
    places = pa.table({"__size": pa.array([k for k, _ in histogram], pa.int64()), "__first": pa.array(first, pa.int64()), "__upto": pa.array(list(upto), pa.list_(pa.int64()))})
    ranked = global_rank(groups, [F.desc("bytes"), F.col("group")], "shard-groups", "__rank", max(32, -(-count // 1_000_000)))
    ranked = lookup(ranked.withColumnRenamed("bytes", "__size"), held(spark.createDataFrame(places)), "__size")
    place = F.col("__rank") - F.col("__first")
    ranked = held(ranked.select(F.col("group").alias("__group"), "rows", F.size(F.filter("__upto", lambda x: x <= place)).alias("shard")))
    hot = ranked.filter(F.col("rows") > max(HOT_ROWS, (total or 0) // MOST_HOT)).drop("rows")  # MOST_HOT rows at most
    found = rows.join(F.broadcast(hot.withColumnRenamed("shard", "__hot").withColumnRenamed("__group", "__h")), F.col("group") == F.col("__h"), "left")
    cold = F.when(F.col("__hot").isNull(), F.col("group")).otherwise(F.concat(F.lit("-"), F.col("__row") % 1024))  # no group's name
    found = found.withColumn("__cold", cold).join(ranked.drop("rows").withColumnRenamed("shard", "__shard"), F.col("__cold") == F.col("__group"), "left")
    return found.withColumn("shard", F.coalesce("__hot", "__shard")).drop("__h", "__hot", "__cold", "__group", "__shard")


def with_slots(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (with shard, and a number for each row, ``__row``) with ``slot``: gapless from 0 in each shard."""
    rows, order = held(rows), [*order, "__row"]
    largest = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    slices = max(SLICES, -(-largest // SLICE_ROWS))
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("shard", "__slice").count()
    w = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__slice", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__before"))  # a row for each slice
    inside = F.row_number().over(Window.partitionBy("shard", "__slice").orderBy(*order)) - 1
    out = sliced.withColumn("__inside", inside).join(F.broadcast(before), ["shard", "__slice"])
    return out.withColumn("slot", (F.col("__before") + F.col("__inside")).cast("long")).drop("__slice", "__before", "__inside", "__row")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with size, group (SHA-256 of the text), shard and slot. Rows with equal texts share a shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("size", "group", "shard", "slot").withColumn("size", (F.octet_length(body) + FIXED_BYTES).cast("long")).withColumn("group", F.sha2(body.cast("binary"), 256))
    return with_slots(assign(rows.withColumn("__row", F.monotonically_increasing_id()), shards), [doc_id, "group"])


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + FIXED_BYTES).cast("long").alias("size"), F.sha2(body, 256).alias("group"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("__row"))
    out = with_slots(assign(held(rows)), ["doc_id", "group"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
