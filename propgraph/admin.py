"""Commands about the session itself: SHOW REPLICAS, REPLICATION STATUS, REPLICATION LAG, SHARD STATUS; PROMOTE REPLICA."""

from __future__ import annotations

from pyspark.sql import DataFrame


def run(session, text: str) -> DataFrame | None:
    """The command's rows; None if ``text`` is no command."""
    found = _COMMANDS.get(" ".join(text.upper().split()).rstrip("; "))
    if found is None:
        return None
    columns, rows = found(session)
    return session.graph.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def _message(text: str) -> tuple[list[str], list[tuple]]:
    return ["message"], [(text,)]


def _streams(session) -> list:
    return [q for q in session.graph.spark.streams.active if (q.name or "").startswith("replica")]


def _acked(name: str) -> int:
    """The last number that a replica has applied; 0 if it is not known in this process."""
    from .streaming.changelog import following

    return following[name].last_lsn if name in following else 0


def _behind(session, name: str) -> int:
    return session.store.log.bytes_after(_acked(name)) if session.store.log is not None else 0


def _replicas(session):
    if session.read_only:
        return _message("only a primary has replicas")
    rows = [(q.name, "active" if q.isActive else "stopped", str(_behind(session, q.name)), str(_acked(q.name))) for q in _streams(session)]
    return ["id", "state", "lag_bytes", "acked_lsn"], rows


def _status(session):
    return ["role", "shards", "mode"], [("replica" if session.read_only else "primary", str(_shards(session)), "async")]


def _lag(session):
    if session.read_only:
        return _message("only a primary has replicas")
    rows = [(q.name, "0", str(_behind(session, q.name)), str((q.lastProgress or {}).get("durationMs", {}).get("triggerExecution", 0))) for q in _streams(session)]
    return ["replica", "shard", "lag_bytes", "lag_ms"], rows


def _shards(session) -> int:
    return int(session.graph.spark.conf.get("spark.sql.shuffle.partitions"))


def _shard_status(session):
    return ["shard", "status"], [(str(i), "running") for i in range(_shards(session))]


def _promote(session):
    if not session.read_only:
        return _message("this is the primary already")
    session.read_only = False
    return _message("this replica is the primary now")


_COMMANDS = {
    "SHOW REPLICAS": _replicas,
    "SHOW REPLICATION STATUS": _status,
    "SHOW REPLICATION LAG": _lag,
    "SHOW SHARD STATUS": _shard_status,
    "PROMOTE REPLICA": _promote,
}
