"""Helpers that the operators share: tables written to the cluster's shared folder, ranks, joins."""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, written  # noqa: F401

#: ASCII white space, as the contents of a character class of Java's, Python's and DuckDB's regexes.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: A table is broadcast only below this many rows (it is counted first); beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows to and from Python, unless the session asks for something else: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def held(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept by the executors, in memory or on disk; what a lost executor held is computed
    again from its sources. For tables that are read several times and whose rows do not depend on their order."""
    return _held.setdefault(df.sparkSession, []).append(out := df.persist()) or out


_held: WeakKeyDictionary[SparkSession, list[DataFrame]] = WeakKeyDictionary()


def release(spark: SparkSession) -> None:
    """Gives back what ``held`` keeps for the session's earlier operators; for when their results have been written."""
    for df in _held.pop(spark, []):
        df.unpersist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*cols: Column | int) -> Column:
    """A number in [0, 1) from a hash of the columns: the same in each run and on each executor."""
    h = F.xxhash64(*(F.lit(c) if isinstance(c, int) else c for c in cols))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def global_rank(df: DataFrame, order: Sequence[Column], name: str, out: str, partitions: int = 32) -> DataFrame:
    """``df`` with ``out``: its row's place, from 0, in the whole order.

    Rows are range-partitioned and written with their place in the partition, then each partition's offset is
    added. The driver gets one row for each partition; no task sees more than its range.
    """
    pid, idx = "__rank_pid", "__rank_idx"
    dealt = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = dealt.withColumn(pid, F.spark_partition_id()).withColumn(idx, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    numbered = written(numbered, name)
    counts = sorted((r[0], r[1]) for r in numbered.groupBy(pid).count().collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    small = df.sparkSession.createDataFrame(offsets, f"{pid} int, __rank_offset long")
    return numbered.join(F.broadcast(small), pid).withColumn(out, F.col("__rank_offset") + F.col(idx)).drop(pid, idx, "__rank_offset")


def lookup(big: DataFrame, small: DataFrame, key: str, salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` left-joined to ``small`` (one row for each key; null equals null) on ``key``.

    ``small`` should be held or written: it is counted, and broadcast if it has no more than ``limit`` rows. Else
    the key is salted, so that a key with a third of the rows goes to several tasks.
    """
    other = small.withColumnRenamed(key, "__key")
    if small.count() <= limit:
        return big.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = other.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = dealt.join(copies, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__salt2")), "left")
    return found.drop("__key", "__salt", "__salt2")
