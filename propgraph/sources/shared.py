"""Tables and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a new local folder only where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and it survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, out: str) -> tuple[DataFrame, int]:
    """``df``, written, with ``out``: numbers from 0 without gaps; and how many rows it has.

    The driver gets a row for each partition; the numbers of the partitions' first rows are a constant of the plan, so
    that reading the result takes no join.
    """
    pid, idx = "__pid", "__idx"
    rows = written(df.withColumn(pid, F.spark_partition_id()).withColumn(idx, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    sizes = {r[0]: r[1] for r in rows.groupBy(pid).count().collect()}
    before, first = 0, []
    for p in range(max(sizes, default=0) + 1):
        first.append(str(before))
        before += sizes.get(p, 0)
    offset = F.element_at(F.split(F.lit(",".join(first)), ",").cast("array<bigint>"), F.col(pid) + 1)
    return rows.withColumn(out, offset + F.col(idx)).drop(pid, idx), before


def numbered(df: DataFrame, name: str, out: str) -> DataFrame:
    """``df``, written, with ``out``: numbers from 0 without gaps."""
    return counted(df, name, out)[0]
