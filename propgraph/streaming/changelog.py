"""Change logs: committed transactions as rows, and replicas that apply them by Structured Streaming.

A commit appends its changes to the log, between a begin and a commit row, in one write; what was rolled back is
never logged. Every row has a number (lsn) that is used once, the id of the graph, and a checksum; a transaction's rows
have neighbouring numbers, and its id is the first of them. A replica reads the log as a file stream; it keeps rows
back until their whole transaction is there, whatever order files arrive in, applies transactions in the order of
their numbers, skips rows of those that it has applied, and stops for good at a row that fails its checks. A replica
with a folder of its own saves its state there with each batch, and goes on from it after a restart, also if that
state is that it has stopped. The log's files that every replica has applied can be dropped (``retain``).
"""

from __future__ import annotations

import json
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptLogError, GraphError
from ..operators.mutate import Change, Insert, Remove, Update, compacted
from ..session import GraphStore
from ..sources import files
from ..sources.catalog import EDGE_COLUMNS, NODE_COLUMNS
from ..sources.shared import numbered, written

#: Numbers are taken in blocks, so that none is used again after a restart that has lost the last ones.
BLOCK = 10_000
SCHEMA = T.StructType([
    T.StructField("graph_id", T.StringType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("tx_id", T.LongType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("action", T.StringType()),  # begin, insert, update, remove, commit, abort
    T.StructField("meta", T.StringType()),  # JSON: what of the change is the same for all its rows
    T.StructField("id", T.LongType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("body", T.StringType()),  # JSON: properties, or the value
    T.StructField("crc", T.LongType()),
])


def checksum() -> Column:
    parts = [F.coalesce(F.col(f.name).cast("string"), F.lit("\u0000")) for f in SCHEMA.fields if f.name != "crc"]
    return F.crc32(F.concat_ws("\u0001", *parts).cast("binary"))


def _rows(c: Change, step: int) -> DataFrame:
    """A change as log rows, without numbers."""
    if isinstance(c, Insert):
        fixed = NODE_COLUMNS if c.kind == "node" else EDGE_COLUMNS
        names = [f for f in c.df.columns if f not in fixed]
        meta = {"kind": c.kind, "label": c.label, "required": sorted(c.required), "ends": sorted(c.ends), "schema": T.StructType([f for f in c.df.schema.fields if f.name in names]).jsonValue()}
        ends = [F.col(f"_{x}").alias(x) if c.kind == "edge" else F.lit(None).cast("long").alias(x) for x in ("src", "dst")]
        body = F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))) if names else F.lit("{}")
        out, action = c.df.select(F.col("_id").alias("id"), *ends, body.alias("body")), "insert"
    else:
        none = [F.lit(None).cast("long").alias(x) for x in ("src", "dst")]
        meta = {"kind": c.kind, "labels": list(c.labels)}
        if isinstance(c, Update):
            meta |= {"name": c.name, "schema": c.df.select("value").schema.jsonValue()}
            out, action = c.df.select(F.col("_id").alias("id"), *none, F.to_json(F.struct("value")).alias("body")), "update"
        else:
            out, action = c.df.select(F.col("_id").alias("id"), *none, F.lit(None).cast("string").alias("body")), "remove"
    return out.withColumns({"step": F.lit(step), "action": F.lit(action), "meta": F.lit(json.dumps(meta))})


def _change(df: DataFrame, action: str, meta: dict) -> Change:
    """The change whose log rows ``df`` has."""
    if action == "remove":
        return Remove(meta["kind"], tuple(meta["labels"]), df.select(F.col("id").alias("_id")))
    schema = T.StructType.fromJson(meta["schema"])
    body = F.from_json("body", schema).alias("b")
    if action == "update":
        return Update(meta["kind"], tuple(meta["labels"]), meta["name"], df.select(F.col("id").alias("_id"), body).select("_id", "b.value"))
    ends = [F.col(x).alias(f"_{x}") for x in ("src", "dst")] if meta["kind"] == "edge" else []
    rows = df.select(F.col("id").alias("_id"), *ends, body)
    fixed = [c for c in rows.columns if c != "b"]
    rows = rows.select(*fixed, *(F.col(f"b.`{n}`").alias(n) for n in schema.names))
    return Insert(meta["kind"], meta["label"], rows, frozenset(meta["required"]), frozenset(tuple(e) for e in meta["ends"]))


class ChangeLog:
    """A folder of log rows, to which commits append."""

    def __init__(self, spark: SparkSession, path: str, graph_id: str):
        self.spark, self.path, self.graph_id = spark, path, graph_id
        last = self.read().agg(F.max("lsn")).first()[0] if self._there() else None
        self.next_lsn = 1 if last is None else -(-(last + 1) // BLOCK) * BLOCK + 1

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def append(self, changes: list[Change]) -> None:
        """One transaction's rows, numbered in the order of its steps."""
        blank = {"id": None, "src": None, "dst": None, "body": None, "meta": None}
        marks = self.spark.createDataFrame([({"step": -1, "action": "begin"} | blank), ({"step": len(changes), "action": "commit"} | blank)], "id long, src long, dst long, body string, step int, action string, meta string")
        rows = reduce(DataFrame.unionByName, [_rows(c, k) for k, c in enumerate(changes)], marks)
        # the commit row gets the last number: steps are ranges, and each partition is numbered after the one before
        dealt = rows.repartitionByRange(8, "step").sortWithinPartitions("step")
        rows = numbered(dealt, "log", "n").withColumns({"graph_id": F.lit(self.graph_id), "tx_id": F.lit(self.next_lsn).cast("long"), "lsn": F.col("n") + self.next_lsn})
        rows = rows.withColumn("crc", checksum()).select(*SCHEMA.names)
        self.next_lsn += rows.count()
        rows.write.mode("append").parquet(self.path)


    def bytes_after(self, lsn: int) -> int:
        """How much of the log, about, lies after a row."""
        size = sum((F.octet_length(F.coalesce(F.col(f.name).cast("string"), F.lit(""))) for f in SCHEMA.fields), F.lit(0))
        return self.read().filter(F.col("lsn") > lsn).agg(F.sum(size)).first()[0] or 0 if self._there() else 0

    def retain(self, acked: int) -> int:
        """Drops the files all of whose rows are numbered ``acked`` or less (the least of what the replicas have applied)
        and gives their number. The file with the last row stays, so that numbers are not used again."""
        if not self._there():
            return 0
        files = self.read().groupBy(F.input_file_name().alias("file")).agg(F.max("lsn").alias("last"))
        files = [(r["last"], r["file"]) for r in files.orderBy("last").collect()]  # a row for each file
        jvm, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        old = [f for last, f in files[:-1] if last <= acked]
        for f in old:
            jvm.Path(f).getFileSystem(conf).delete(jvm.Path(f), False)
        return len(old)


#: Replicas that follow a log in this process, by the names of their streams.
following: dict[str, Replica] = {}


class Replica:
    """A store that follows a log. With ``path`` it saves its state after each batch, and begins with what is there."""

    def __init__(self, store: GraphStore, graph_id: str, path: str | None = None):
        self.store, self.graph_id, self.path = store, graph_id, path
        self.applied: list[list[int]] = []  # ranges of numbers, first and last; neighbours are one
        self.poisoned = False
        self.pending: DataFrame | None = None
        self._lock = threading.Lock()
        spark = store.graph.spark
        if path and files.versions(spark, path):
            state = files.more(spark, path)
            if state["graph_id"] != graph_id:
                raise CorruptLogError("the replica is of another graph")
            graph, first = files.load(spark, path)
            store.graph, store.next_id = graph, max(first, store.next_id)
            self.applied, self.poisoned = state["applied"], state["poisoned"]
            if state["pending"]:
                self.pending = spark.read.schema(SCHEMA).parquet(state["pending"])

    @property
    def last_lsn(self) -> int:
        return self.applied[-1][1] if self.applied else 0

    def _save(self) -> None:
        if self.path:
            pending = f"{self.path}/pending-{uuid.uuid4().hex}" if self.pending is not None else None
            if pending:
                self.pending.write.parquet(pending)
            files.save(self.store.graph, self.path, self.store.next_id, {"graph_id": self.graph_id, "applied": self.applied, "poisoned": self.poisoned, "pending": pending})

    def _stop(self, why: str) -> None:
        self.poisoned = True
        self._save()
        raise CorruptLogError(why)

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A batch of log rows; rows that were had before change nothing."""
        with self._lock:
            if self.poisoned:
                raise CorruptLogError("the replica has stopped at a corrupt row")
            if not {f.name for f in SCHEMA.fields} <= set(batch.columns):
                self._stop("the log has other columns")
            for first, last in self.applied:
                batch = batch.filter(~F.col("lsn").between(first, last))
            rows = written(batch.select(*SCHEMA.names).dropDuplicates(["lsn"]), "log-batch")
            bad = rows.filter((checksum() != F.col("crc")) | F.col("crc").isNull())
            if not bad.isEmpty():
                self._stop(f"the checksum of row {bad.first()['lsn']} differs")
            if not rows.filter(F.col("graph_id") != self.graph_id).isEmpty():
                self._stop("the log is of another graph")
            if rows.isEmpty():
                return
            waiting = rows if self.pending is None else written(self.pending.unionByName(rows).dropDuplicates(["lsn"]), "log-waiting")
            end = F.max(F.when(F.col("action").isin("commit", "abort"), F.col("lsn")))
            ended = waiting.groupBy("tx_id").agg(end.alias("last"), F.count("*").alias("n"), F.max(F.col("action") == "abort").alias("aborted"))
            # a transaction is whole if as many rows are there as it has numbers
            ended = ended.filter(F.col("last") - F.col("tx_id") + 1 == F.col("n")).orderBy("tx_id").collect()
            graph = self.store.graph
            steps = waiting.filter("meta is not null").groupBy("tx_id", "step", "action", "meta").agg(F.min("lsn").alias("first"), F.max("lsn").alias("last")).orderBy("first").collect() if ended else []
            whole = {r["tx_id"] for r in ended if not r["aborted"]}
            for s in steps:
                if s["tx_id"] in whole:
                    # the rows of a step as a table of their own, so that the graph does not hold on to the batch
                    own = waiting.filter(F.col("lsn").between(s["first"], s["last"]) & (F.col("step") == s["step"]))
                    graph = _change(written(own.select("id", "src", "dst", "body"), "log-step"), s["action"], json.loads(s["meta"])).over(graph)
            for r in ended:
                waiting = waiting.filter(~F.col("lsn").between(r["tx_id"], r["last"]))
                self.applied.append([r["tx_id"], r["last"]])
            self.applied = _joined(self.applied)
            self.pending = written(waiting, "log-pending") if ended else waiting
            if ended:
                self.store.graph = compacted(graph)
                self.store.version += 1
            self._save()

    def follow(self, path: str, checkpoint: str, name: str = "replica"):
        """A stream that applies what is in the log now, and ends; it goes on from there when it is started again."""
        spark = self.store.graph.spark
        following[name] = self
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        q = stream.writeStream.queryName(name).foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return q.trigger(availableNow=True).start()


def _joined(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def replicate(log: ChangeLog, store: GraphStore, checkpoint: str) -> Replica:
    """A replica of ``store``'s graph that has applied the whole log."""
    r = Replica(store, log.graph_id)
    q = r.follow(log.path, checkpoint)
    q.awaitTermination()
    if q.exception():
        raise GraphError(str(q.exception()))
    return r
