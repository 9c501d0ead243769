"""Transactions, files, change logs, commands and the shell."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from propgraph import ConflictError, CorruptLogError, GraphError, GraphSession, GraphStore, PropertyGraph, ReadOnlyError
from propgraph.__main__ import repl
from propgraph.sources import files
from propgraph.sources.shared import new_path
from propgraph.streaming.changelog import BLOCK, ChangeLog, Replica, replicate


@pytest.fixture
def session(spark):
    s = GraphSession(PropertyGraph(spark))
    s.query("CREATE (a:N {n: 'a', v: 0}), (b:N {n: 'b', v: 0})")
    return s


def state(s):
    return sorted(tuple(r) for r in s.query("MATCH (x:N) RETURN x.n, x.v").collect())


def test_snapshot_and_own_writes(session):
    tx = session.begin()
    tx.query("MATCH (x:N {n: 'a'}) SET x.v = 1")
    session.query("MATCH (x:N {n: 'b'}) SET x.v = 7")
    assert sorted(tuple(r) for r in tx.query("MATCH (x:N) RETURN x.n, x.v").collect()) == [("a", 1), ("b", 0)]
    tx.commit()
    assert state(session) == [("a", 1), ("b", 7)]


def test_first_committer_wins(session):
    a, b = session.begin(), session.begin()
    a.query("MATCH (x:N {n: 'a'}) SET x.v = 1")
    b.query("MATCH (x:N {n: 'a'}) SET x.v = 2")
    a.commit()
    with pytest.raises(ConflictError, match="conflict"):
        b.commit()
    assert state(session) == [("a", 1), ("b", 0)]
    with pytest.raises(GraphError):
        b.query("RETURN 1")


def test_deletes_conflict_and_inserts_do_not(session):
    a, b, c = session.begin(), session.begin(), session.begin()
    a.query("MATCH (x:N {n: 'a'}) DELETE x")
    b.query("MATCH (x:N {n: 'a'}) SET x.v = 5")
    c.query("MATCH (x:N {n: 'a'}) CREATE (x)-[:E]->(y:N {n: 'c', v: 3})")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    c.commit()
    assert state(session) == [("b", 0), ("c", 3)]


def test_rollback_and_context(session):
    with pytest.raises(ZeroDivisionError), session.transaction() as tx:
        tx.query("MATCH (x:N) DELETE x")
        raise ZeroDivisionError
    assert len(state(session)) == 2
    with session.transaction() as tx:
        tx.query("CREATE (x:N {n: 'ghost', v: 1})")
        tx.rollback()
    assert len(state(session)) == 2


def test_a_failed_statement_changes_nothing(session):
    with pytest.raises(GraphError):
        session.query("MATCH (x:N) SET x.v = 1, x.v = 'text'")
    assert state(session) == [("a", 0), ("b", 0)]


def test_read_only(session):
    r = GraphSession(session.store, read_only=True)
    for text in ("CREATE (a:X)", "MATCH (x:N) SET x.v = 1", "MATCH (x:N) DELETE x", "MATCH (x:N) CREATE (y:N)"):
        with pytest.raises(ReadOnlyError):
            r.query(text)
    with pytest.raises(ReadOnlyError):
        r.begin()
    assert r.query("show replication status").first()["role"] == "replica"
    assert r.query("PROMOTE REPLICA").first()[0] == "this replica is the primary now"
    r.query("CREATE (a:N {n: 'z', v: 0})")
    assert len(state(r)) == 3


def test_commands(session):
    assert session.query("SHOW REPLICAS;").columns == ["id", "state", "lag_bytes", "acked_lsn"]
    assert session.query("SHOW REPLICATION LAG").count() == 0
    assert session.query("SHOW SHARD STATUS").count() == 4
    assert session.query("PROMOTE REPLICA").first()[0] == "this is the primary already"


def test_created_ids(session):
    """What a statement creates for its rows has ids of its own, row by row, also after another write of the statement."""
    before = set(r[0] for r in session.query("MATCH (x:N) RETURN id(x)").collect())
    out = session.query("MATCH (x:N) CREATE (y:M {of: x.n})-[:R]->(z:M {of: x.n}) SET x.v = 7 CREATE (w:M {of: x.n})")
    assert out.rows_affected == 2
    rows = session.query("MATCH (m:M) RETURN id(m) AS i, m.of AS n").collect()
    assert len({r["i"] for r in rows} | before) == 8 and sorted(r["n"] for r in rows) == ["a"] * 3 + ["b"] * 3
    assert sorted(map(tuple, session.query("MATCH (y:M)-[:R]->(z:M) RETURN y.of, z.of").collect())) == [("a", "a"), ("b", "b")]
    assert state(session) == [("a", 7), ("b", 7)]
    assert session.query("MATCH (x:N) WHERE x.n = 'none' CREATE (y:Empty {k: 1})").rows_affected == 0
    assert session.query("MATCH (y:Empty) RETURN y.k").count() == 0


def test_files(spark, session):
    path = new_path(spark, "files")
    with pytest.raises(GraphError):
        files.load(spark, path)
    assert files.save(session.graph, path, session.store.next_id) == 1
    session.query("MATCH (x:N {n: 'a'}) DELETE x")
    assert files.save(session.graph, path, session.store.next_id) == 2
    graph, first = files.load(spark, path)
    s = GraphSession(GraphStore(graph, first_id=first))
    assert state(s) == [("b", 0)] and not graph.whole
    s.query("CREATE (x:N {n: 'c', v: 1})")
    assert s.query("MATCH (x:N) RETURN id(x)").distinct().count() == 2
    assert state(GraphSession(files.load(spark, path, 1)[0])) == [("a", 0), ("b", 0)]
    # a version without its manifest is not there
    spark.range(1).write.parquet(f"{path}/v00000003/nodes/0000")
    assert files.versions(spark, path) == [1, 2]


def _logged(spark):
    s = GraphSession(PropertyGraph(spark))
    s.store.log = ChangeLog(spark, new_path(spark, "log"), s.store.graph_id)
    s.query("CREATE (a:N {n: 'a', v: 1})-[:E {w: 0.5}]->(b:N {n: 'b', v: 2})")
    s.query("MATCH (x:N {n: 'b'}) SET x.v = 9")
    return s


def test_replica_follows_and_repeats_change_nothing(spark):
    s = _logged(spark)
    checkpoint = new_path(spark, "cp")
    r = replicate(s.store.log, GraphStore(PropertyGraph(spark)), checkpoint)
    out = GraphSession(r.store, read_only=True)
    assert state(out) == state(s) == [("a", 1), ("b", 9)]
    version = r.store.version
    r.apply(s.store.log.read())
    assert r.store.version == version
    s.query("MATCH (x:N {n: 'a'}) DELETE x")
    r.follow(s.store.log.path, checkpoint).awaitTermination()
    assert state(out) == [("b", 9)]


def test_replica_waits_for_the_commit(spark):
    s = _logged(spark)
    log = s.store.log.read().orderBy("lsn").collect()
    rows = spark.createDataFrame(log, s.store.log.read().schema)
    r = Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id)
    first_commit = next(x["lsn"] for x in log if x["action"] == "commit")
    r.apply(rows.filter(F.col("lsn") < first_commit))
    assert not r.store.graph.nodes
    r.apply(rows.filter(F.col("lsn") >= first_commit))
    assert state(GraphSession(r.store)) == [("a", 1), ("b", 9)]


def test_replica_stops_at_corrupt_rows(spark):
    s = _logged(spark)
    r = Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id)
    bad = s.store.log.read().withColumn("body", F.when(F.col("lsn") == 2, F.lit("{}")).otherwise(F.col("body")))
    with pytest.raises(CorruptLogError):
        r.apply(bad)
    with pytest.raises(CorruptLogError):
        r.apply(s.store.log.read())
    with pytest.raises(CorruptLogError):
        Replica(GraphStore(PropertyGraph(spark)), "another").apply(s.store.log.read())


def test_rows_that_arrive_in_any_order(spark):
    """Files of later transactions first, and a commit row before its transaction's other rows."""
    s = _logged(spark)
    log = s.store.log.read().orderBy("lsn").collect()
    r = Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id)
    second = max(x["tx_id"] for x in log)
    for part in ([x for x in log if x["tx_id"] == second], [x for x in log if x["tx_id"] != second][2:], log[:2], log):
        r.apply(spark.createDataFrame(part, s.store.log.read().schema))
    assert r.applied == [[1, log[-1]["lsn"]]] and r.store.graph.nodes
    assert {x[0] for x in state(GraphSession(r.store))} == {"a", "b"}


def test_a_replica_goes_on_after_a_restart(spark):
    s, path = _logged(spark), new_path(spark, "replica")
    log = s.store.log.read().orderBy("lsn").collect()
    rows = spark.createDataFrame(log, s.store.log.read().schema)
    cut = next(x["lsn"] for x in log if x["action"] == "commit") + 1
    Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id, path).apply(rows.filter(F.col("lsn") <= cut))
    again = Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id, path)
    assert again.last_lsn == cut - 1 and again.pending.count() == 1 and state(GraphSession(again.store)) == [("a", 1), ("b", 2)]
    again.apply(rows)
    assert state(GraphSession(Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id, path).store)) == [("a", 1), ("b", 9)]
    with pytest.raises(CorruptLogError):
        Replica(GraphStore(PropertyGraph(spark)), "another", path)
    s.query("MATCH (x:N {n: 'a'}) DELETE x")
    with pytest.raises(CorruptLogError):
        again.apply(s.store.log.read().withColumn("crc", F.lit(1).cast("long")))
    with pytest.raises(CorruptLogError):
        Replica(GraphStore(PropertyGraph(spark)), s.store.graph_id, path).apply(s.store.log.read())


def test_what_all_have_applied_can_be_dropped(spark):
    s = _logged(spark)
    log, checkpoint = s.store.log, new_path(spark, "cp")
    r = replicate(log, GraphStore(PropertyGraph(spark)), checkpoint)
    before = log.read().count()
    assert log.bytes_after(0) > log.bytes_after(3) > 0 == log.bytes_after(r.last_lsn)
    assert log.retain(0) == 0 and log.read().count() == before
    assert log.retain(r.last_lsn) > 0 and 0 < log.read().count() < before
    s.query("MATCH (x:N {n: 'a'}) SET x.v = 5")
    r.follow(log.path, checkpoint).awaitTermination()
    assert state(GraphSession(r.store)) == [("a", 5), ("b", 9)]


def test_flush(spark):
    s, path = _logged(spark), new_path(spark, "flushed")
    assert s.flush(path) == 1 and state(GraphSession(files.load(spark, path)[0])) == state(s)


def test_numbers_are_not_used_again(spark):
    s = _logged(spark)
    log = ChangeLog(spark, s.store.log.path, s.store.graph_id)
    assert log.next_lsn == BLOCK + 1
    lsns = [r[0] for r in log.read().select("lsn").collect()]
    assert len(lsns) == len(set(lsns))


def test_shell(spark, capsys):
    s = GraphSession(PropertyGraph(spark))
    repl(s, ["CREATE (a:N {n: 'x'})\n", ";\n", "MATCH (a:N) RETURN a.n AS name;\n", "BROKEN;\n", "\\status\n", "\\help\n", "\\quit\n", "never;\n"])
    out = capsys.readouterr().out
    assert "OK (1 rows affected)" in out and "|x   |" in out and "error:" in out and "primary" in out and "never" not in out


@pytest.mark.parametrize("key", [-1, 255 << 48, 1 << 60])
def test_keys_that_ids_have_no_room_for(spark, key):
    g = PropertyGraph(spark).add_nodes("P", spark.createDataFrame([(1,), (key,), (None,)], "k long"), "k")
    with pytest.raises(PySparkException, match="negative or too large"):
        GraphSession(g).query("MATCH (p:P) RETURN id(p) AS i").collect()


def test_loaded_and_created_ids_differ(spark):
    most = (255 << 48) - 1
    s = GraphSession(PropertyGraph(spark).add_nodes("P", spark.createDataFrame([(0,), (1 << 48,), (most,)], "k long"), "k"))
    s.query("CREATE (a:P), (b:P)")
    ids = [r[0] for r in s.query("MATCH (p:P) RETURN id(p) AS i").collect()]
    assert len(set(ids)) == 5 and all(i >> 56 == 1 for i in ids)
