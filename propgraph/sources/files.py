"""Graphs in files: a folder with a sub-folder for each version, and in it a Parquet table for each label.

A version is there when its manifest is, which is written last; opening takes the newest one. Any file system that
Spark knows will do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import GraphError
from .catalog import PropertyGraph, Table

MANIFEST = "_graph"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(jvm.Path(s.getPath(), f"{MANIFEST}/_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def save(graph: PropertyGraph, path: str, next_id: int = 0, more: dict | None = None) -> int:
    """Writes a new version, with ``more`` (of JSON's kinds) in its manifest, and gives its number."""
    spark = graph.spark
    number = max(versions(spark, path), default=0) + 1
    at = f"{path}/v{number:08d}"
    manifest = {"whole": graph.whole, "next_id": next_id, "tags": [[k, x, t] for (k, x), t in graph.tags.items()], "tables": [], "more": more or {}}
    for kind in ("node", "edge"):
        for k, (label, t) in enumerate(graph.tables(kind).items()):
            name = f"{kind}s/{k:04d}"
            t.df.write.mode("overwrite").parquet(f"{at}/{name}")  # what an unfinished save may have left
            manifest["tables"].append([kind, label, name, sorted(t.required), None if t.ends is None else sorted(t.ends), t.df.schema.jsonValue()])
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/{MANIFEST}")
    return number


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[str, dict]:
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise GraphError(f"{path} has no {'such ' if there else ''}version of a graph")
    at = f"{path}/v{version or there[-1]:08d}"
    return at, json.loads("".join(r[0] for r in spark.read.text(f"{at}/{MANIFEST}").collect()))


def more(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What was saved with a version beside the graph."""
    return _manifest(spark, path, version)[1].get("more", {})


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[PropertyGraph, int]:
    """The graph of a version (the newest, if none is given), and its next id."""
    from pyspark.sql.types import StructType

    at, m = _manifest(spark, path, version)
    g = PropertyGraph(spark, tags={(k, x): t for k, x, t in m["tags"]}, whole=m["whole"])
    for kind, label, name, required, ends, schema in m["tables"]:
        df = spark.read.schema(StructType.fromJson(schema)).parquet(f"{at}/{name}")
        g = g.with_table(kind, label, Table(df, frozenset(required), None if ends is None else frozenset(tuple(e) for e in ends)))
    return g, m["next_id"]
