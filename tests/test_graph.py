"""Statements on small graphs: the language's rules, one by one."""

import math

import pytest
from pyspark.errors import PySparkException

from propgraph import AnalysisError, GraphSession, PropertyGraph


def session(spark, *statements):
    s = GraphSession(PropertyGraph(spark))
    for t in statements:
        s.query(t)
    return s


def rows(s, text):
    return [tuple(r) for r in s.query(text).collect()]


def values(s, text):
    return sorted(r[0] for r in rows(s, text))


@pytest.fixture(scope="module")
def ports(spark):
    """Harbours and the ferries between them."""
    return session(
        spark,
        "CREATE (k:Port {town: 'Kiel', piers: 4, cold: 1.5})-[:FERRY {hours: 14}]->(g:Port {town: 'Gothenburg', piers: 7, cold: -0.5}), (g)-[:FERRY {hours: 3}]->(f:Port {town: 'Frederikshavn', piers: 2})",
        "MATCH (k:Port {town: 'Kiel'}), (f:Port {town: 'Frederikshavn'}) CREATE (k)-[:FERRY {hours: 9}]->(f), (f)-[:RAIL {hours: 5}]->(:Stop {town: 'Aarhus'})",
    )


@pytest.fixture(scope="module")
def chain(spark):
    return session(spark, "CREATE (a:N {name: 'A'})-[:E]->(b:N {name: 'B'})-[:E]->(c:N {name: 'C'})-[:E]->(d:N {name: 'D'})")


@pytest.fixture(scope="module")
def sparse(spark):
    """Nodes with a missing, an integer and a float property."""
    return session(spark, "CREATE (a:V {k: 1}), (b:V {k: 2, x: 5}), (c:V {k: 3, x: 2.5}), (d:V {k: 4, x: 0})")


def test_patterns_and_properties(ports):
    assert values(ports, "MATCH (p:Port) WHERE p.piers >= 4 AND p.cold IS NOT NULL RETURN p.town") == ["Gothenburg", "Kiel"]
    assert values(ports, "MATCH (p) WHERE p.town ENDS WITH 's' OR p.piers = 2 RETURN p.town") == ["Aarhus", "Frederikshavn"]
    assert rows(ports, "MATCH (:Stop)<-[r]-(p) RETURN p.town, type(r), r.hours * 60") == [("Frederikshavn", "RAIL", 300)]
    assert rows(ports, "MATCH (a)-[x:FERRY]->(b)-[y:FERRY]->(c) RETURN a.town, c.town, x.hours + y.hours") == [("Kiel", "Frederikshavn", 17)]
    assert rows(ports, "MATCH (p:Port)-[e:FERRY]->(:Port) WHERE e.hours > 5 RETURN COUNT(*), SUM(e.hours), AVG(p.piers)") == [(2, 23.0, 4.0)]
    assert rows(ports, "MATCH (a:Port), (b:Port) WHERE a.piers > 2 * b.piers RETURN a.town, b.town") == [("Gothenburg", "Frederikshavn")]


def test_order_of_distinct_rows(spark):
    """Distinct rows come in the order of the first one of each, also by what is not returned."""
    s = session(spark, "CREATE (:P {n: 'x', k: 4}), (:P {n: 'y', k: 3}), (:P {n: 'z', k: 2}), (:P {n: 'm', k: 5}), (:P {n: 'q', k: 9}), (:P {n: 'm', k: 0}), (:P {n: 'z', k: 7}), (:P {n: 'w'})")
    one = lambda q: [r[0] for r in rows(s, q)]
    assert one("MATCH (p:P) RETURN DISTINCT p.n AS n ORDER BY p.k DESC") == ["q", "z", "m", "x", "y", "w"]
    assert one("MATCH (p:P) RETURN DISTINCT p.n AS n ORDER BY p.k") == ["w", "m", "z", "y", "x", "q"]
    assert one("MATCH (p:P) RETURN DISTINCT p.n AS n ORDER BY n DESC") == ["z", "y", "x", "w", "q", "m"]
    assert one("MATCH (p:P) RETURN DISTINCT p.n AS n ORDER BY p.k DESC LIMIT 3") == ["q", "z", "m"]
    assert one("MATCH (p:P) RETURN DISTINCT p.k > 4 AS big ORDER BY p.k DESC") == [True, False, None]


def test_the_last_of_several_sets_stays(spark):
    s = session(spark, "CREATE (h:Hub {v: 0})", "MATCH (h:Hub) CREATE (:Leaf {i: 1})-[:OF]->(h), (:Leaf {i: 2})-[:OF]->(h), (:Leaf {i: 3})-[:OF]->(h), (:Leaf)-[:OF]->(:Hub {v: 8})")
    found = rows(s, "MATCH (l:Leaf)-[:OF]->(h:Hub) SET h.v = l.i RETURN id(l), id(h), l.i")
    last = {h: i for _, h, i in sorted(found, key=lambda r: r[0])}  # of the rows of a hub, the one with the last leaf
    assert dict(rows(s, "MATCH (h:Hub) RETURN id(h), h.v")) == last and len(last) == 2 and None in last.values()


def test_quantifiers(chain):
    q = "MATCH (a:N {{name: 'A'}})-[:E{}]->(b:N) RETURN b.name"
    for form, expected in (("*", "BCD"), ("*2", "C"), ("*1..2", "BC"), ("*2..", "CD"), ("*..2", "BC"), ("*0..1", "AB"), ("*0", "A"), ("*5", "")):
        assert values(chain, q.format(form)) == list(expected), form
    assert values(chain, "MATCH (a:N {name: 'C'})<-[:E*]-(b) RETURN b.name") == ["A", "B"]
    assert values(chain, "MATCH (a:N {name: 'B'})-[:E*1..2]-(b) RETURN b.name") == ["A", "C", "D"]


def test_paths_take_the_least_depth(spark):
    s = session(spark, "CREATE (a:M {n: 'A'})-[:E]->(b:M {n: 'B'}), (a)-[:E]->(c:M {n: 'C'}), (b)-[:E]->(d:M {n: 'D'}), (d)-[:E]->(e:M {n: 'E'}), (c)-[:E]->(e), (e)-[:E]->(f:M {n: 'F'})")
    assert values(s, "MATCH (a:M {n: 'A'})-[:E*1..3]->(x) RETURN x.n") == list("BCDEF")
    assert values(s, "MATCH (a:M {n: 'A'})-[:E*3]->(x) RETURN x.n") == ["F"]


def test_cycles_and_self_loops(spark):
    s = session(spark, "CREATE (a:C {n: 'A'})-[:E]->(b:C {n: 'B'})-[:E]->(c:C {n: 'C'}), (c)-[:E]->(a), (a)-[:E]->(a)")
    assert values(s, "MATCH (a:C {n: 'A'})-[:E*]->(x) RETURN x.n") == ["B", "C"]
    assert values(s, "MATCH (a:C {n: 'A'})-[:E*0..2]->(x) RETURN x.n") == ["A", "B", "C"]
    assert values(s, "MATCH (a:C {n: 'A'})-[:E]-(x) RETURN x.n") == ["A", "A", "B", "C"]
    assert rows(s, "MATCH (a)-[:E]->(a) RETURN a.n") == [("A",)]


def test_bags_and_distinct(spark):
    s = session(spark, "CREATE (a:D {n: 'A'})-[:E]->(b:D {n: 'B'})-[:E]->(d:D {n: 'D'}), (a)-[:E]->(c:D {n: 'C'})-[:E]->(d), (a)-[:E]->(b)")
    assert values(s, "MATCH (a:D {n: 'A'})-[:E]->()-[:E]->(d) RETURN d.n") == ["D", "D", "D"]
    assert values(s, "MATCH (a:D {n: 'A'})-[:E]->()-[:E]->(d) RETURN DISTINCT d.n") == ["D"]
    # a walk may come back over the edge it went
    assert ("B", "B") in rows(s, "MATCH (x:D {n: 'B'})-[:E]-(m)-[:E]-(y) RETURN x.n, y.n")


def test_equality_is_two_valued(sparse):
    assert values(sparse, "MATCH (v:V) WHERE v.x = NULL RETURN v.k") == [1]
    assert values(sparse, "MATCH (v:V) WHERE v.x <> 5 RETURN v.k") == [1, 3, 4]
    assert rows(sparse, "RETURN NULL = NULL, NULL <> 1, NULL = 1") == [(True, True, False)]


def test_and_or_not_with_nulls(sparse):
    assert values(sparse, "MATCH (v:V) WHERE v.x > 1 OR v.k > 0 RETURN v.k") == [2, 3, 4]
    assert values(sparse, "MATCH (v:V) WHERE NOT v.x > 1 RETURN v.k") == [1, 4]
    assert rows(sparse, "RETURN TRUE OR NULL, NULL AND FALSE, (NULL AND FALSE) OR TRUE, NOT NULL") == [(None, None, None, True)]
    assert values(sparse, "MATCH (v:V) WHERE (v.x > 1 AND FALSE) IS NULL RETURN v.k") == [1]


def test_truthiness(sparse):
    assert values(sparse, "MATCH (v:V) WHERE v.x RETURN v.k") == [2, 3]
    assert rows(sparse, "RETURN NOT '', NOT 'a', NOT 0.0, NOT 3") == [(True, False, True, False)]
    assert rows(sparse, "MATCH (v:V) WHERE v RETURN COUNT(*)") == [(4,)]


def test_mixed_kinds(sparse):
    assert rows(sparse, "RETURN 1 = 1.0, 1 = '1', 1 <> '1', 1 < 'a', 1 <= 'a', 2 > 1.5, NULL < 1") == [(True, False, True, False, True, True, None)]
    assert rows(sparse, "MATCH (a:V {k: 1}), (b:V {k: 1}) RETURN a = b, a <> b, a = 1") == [(True, False, False)]


def test_arithmetic(sparse):
    assert rows(sparse, "RETURN 7 / 2, -7 / 2, 7 % 3, -7 % 3, 7 / 2.0, 1 + NULL, -(3)") == [(3, -3, 1, -1, 3.5, None, -3)]
    assert math.isnan(rows(sparse, "RETURN 5.0 % 0.0")[0][0])
    for bad in ("RETURN 1 / 0", "RETURN 1 % 0", "RETURN 1.0 / 0.0", "RETURN 9223372036854775807 + 1"):
        with pytest.raises(PySparkException):
            rows(sparse, bad)
    for bad in ("RETURN 'a' + 1", "RETURN -'a'", "RETURN 1 CONTAINS 'a'"):
        with pytest.raises(AnalysisError):
            rows(sparse, bad)


def test_conversions(sparse):
    assert rows(sparse, "RETURN toString(1.0), toString(NULL), toString(TRUE), toString(1.5), toString(-0.25)") == [("1", "NULL", "true", "1.5", "-0.25")]
    big = "RETURN toString(1000000000000000000000.0), toString(0.00000012), toString(-12345678901.5), toString(123456789012345680000.0)"
    assert rows(sparse, big) == [("1000000000000000000000", "0.00000012", "-12345678901.5", "123456789012345680000")]
    assert rows(sparse, "RETURN toInteger('42'), toInteger(3.9), toInteger(-3.9), toInteger(TRUE), toInteger(NULL), toInteger(1000000000000000000000.0)") == [(42, 3, -3, 1, None, 2**63 - 1)]
    assert rows(sparse, "RETURN toFloat('3.14'), toFloat(2), toFloat(NULL), toFloat('1e3')") == [(3.14, 2.0, None, 1000.0)]
    for bad in ("toInteger('3.7')", "toInteger('abc')", "toInteger(' 5')", "toFloat('x')"):
        with pytest.raises(PySparkException):
            rows(sparse, f"RETURN {bad}")
    for bad in ("toFloat(TRUE)", "nope(1)", "toString()", "type(1)"):
        with pytest.raises(AnalysisError):
            rows(sparse, f"RETURN {bad}")


def test_display_of_entities(chain):
    text = rows(chain, "MATCH (a:N {name: 'A'})-[e:E]->(b) RETURN toString(a), toString(e)")[0]
    assert text[0].startswith("(:N {id: n") and text[1].startswith("[:E {id: e") and "->" in text[1]


def test_aggregates(sparse):
    assert rows(sparse, "MATCH (v:V) RETURN COUNT(*), COUNT(v.x), COUNT(v), SUM(v.x), AVG(v.x), MIN(v.x), MAX(v.x)") == [(4, 3, 4, 7.5, 2.5, 0.0, 5.0)]
    assert rows(sparse, "MATCH (v:V) WHERE v.k > 99 RETURN COUNT(*), SUM(v.x), AVG(v.x), MIN(v.x)") == [(0, 0.0, None, None)]
    assert rows(sparse, "MATCH (v:V) RETURN MIN('a'), SUM('a'), SUM(10 / v.k), count(*)") == [(None, 0.0, 20.0, 4)]
    assert rows(sparse, "MATCH (v:V) RETURN DISTINCT COUNT(*) LIMIT 2") == [(2,)]
    with pytest.raises(AnalysisError):
        rows(sparse, "MATCH (v:V) RETURN v.k, COUNT(*)")
    with pytest.raises(AnalysisError):
        rows(sparse, "MATCH (v:V) RETURN COUNT(*) + 1")


def test_order_skip_limit(sparse):
    assert [r[0] for r in rows(sparse, "MATCH (v:V) RETURN v.k ORDER BY v.x")] == [1, 4, 3, 2]
    assert [r[0] for r in rows(sparse, "MATCH (v:V) RETURN v.k ORDER BY v.x DESC")] == [2, 3, 4, 1]
    assert [r[0] for r in rows(sparse, "MATCH (v:V) RETURN 0 - v.k AS m ORDER BY m SKIP 1 LIMIT 2")] == [-3, -2]
    assert [r[0] for r in rows(sparse, "MATCH (v:V) RETURN DISTINCT v.x ORDER BY v.x DESC")] == [5.0, 2.5, 0.0, None]
    assert rows(sparse, "MATCH (v:V) RETURN v.k LIMIT 0") == []
    assert len(rows(sparse, "MATCH (v:V) RETURN DISTINCT v.x IS NULL ORDER BY v.x LIMIT 1")) == 1


def test_column_names(ports):
    assert ports.query("MATCH (p:Port) RETURN p.town, p.piers + 1, p.town, toString(p.piers) LIMIT 0").columns == ["p.town", "p.piers + 1", "p.town_2", "toString(p.piers)"]
    assert ports.query("MATCH (p:Port) RETURN COUNT(*)").columns == ["COUNT(*)"]
    assert ports.query("MATCH (p:Nobody) RETURN p.town AS n").columns == ["n"]


def test_unbound_and_unsupported(ports):
    for bad in (
        "MATCH (a) RETURN b.x", "RETURN x", "MATCH (a) WHERE b.x = 1 RETURN a", "MATCH (a)-[e*1..2]->(b) RETURN a", "MATCH (a)-[:K*2 {x: 1}]->(b) RETURN a",
        "SET a.x = 1", "DELETE a", "WHERE 1 = 1 RETURN 1", "CREATE (a)-[:K*2]->(b)", "MATCH (a:Person) CREATE (b:P {x: a})", "MATCH (a)-[e]->(b), (c)-[e]->(d) RETURN a",
    ):
        with pytest.raises(AnalysisError):
            rows(ports, bad)


def test_anonymous_and_correlated(ports):
    assert values(ports, "MATCH (:Port {town: 'Kiel'})-[:FERRY {hours: 9}]->(b) RETURN b.town") == ["Frederikshavn"]
    assert rows(ports, "MATCH (a:Port), (b:Port {piers: a.piers - 3}) RETURN a.town, b.town ORDER BY a.town") == [("Gothenburg", "Kiel")]
    assert rows(ports, "MATCH (a:Port {town: 'Gothenburg'}) MATCH (x)-[:FERRY]->(a) RETURN x.town") == [("Kiel",)]


def test_unlabelled_nodes_and_edges(spark):
    s = session(spark, "CREATE (a {n: 1})-[:K]->(b:L {n: 2})", "MATCH (a {n: 1}), (b:L) CREATE (b)-[]->(a)")
    assert values(s, "MATCH (x) RETURN x.n") == [1, 2]
    assert rows(s, "MATCH (x:L)-[e]->(y) RETURN type(e), labels(y), labels(x)") == [(None, None, "L")]


def test_writes_and_rows_affected(spark):
    s = session(spark)
    assert s.query("CREATE (a:T {n: 'a', v: 1}), (b:T {n: 'b', v: 2})").rows_affected == 1
    assert s.query("MATCH (t:T) SET t.v = t.v * 10").rows_affected == 2
    assert rows(s, "MATCH (t:T) RETURN t.n, t.v ORDER BY t.n") == [("a", 10), ("b", 20)]
    s.query("MATCH (t:T {n: 'b'}) SET t.v = 99")
    assert rows(s, "MATCH (t:T) RETURN t.n, t.v ORDER BY t.n") == [("a", 10), ("b", 99)]
    s.query("MATCH (t:T) SET t.v = 0.5")
    assert rows(s, "MATCH (t:T) RETURN SUM(t.v)") == [(1.0,)]
    with pytest.raises(AnalysisError):
        s.query("MATCH (t:T) SET t.v = 'text'")
    s.query("MATCH (t:T) SET t.v = NULL")
    assert rows(s, "MATCH (t:T) WHERE t.v IS NULL RETURN COUNT(*)") == [(2,)]
    assert s.query("MATCH (t:T {n: 'a'}) DELETE t").rows_affected == 1
    assert values(s, "MATCH (t:T) RETURN t.n") == ["b"]
    s.query("MATCH (t:T) CREATE (u:U {of: t.n})")
    assert values(s, "MATCH (u:U) RETURN u.of") == ["b"]
    ids = values(s, "MATCH (x) RETURN id(x)")
    assert len(ids) == len(set(ids)) and 0 not in ids


def test_many_changes_are_compacted(spark):
    s = session(spark, "CREATE (a:T {v: 0})")
    for k in range(1, 11):
        s.query(f"MATCH (t:T) SET t.v = {k}")
    assert rows(s, "MATCH (t:T) RETURN t.v") == [(10,)]
    assert s.graph.nodes["T"].depth < 8


def test_deleted_nodes_leave_dangling_edges(spark):
    s = session(spark, "CREATE (a:N {n: 'A'})-[:E]->(b:N {n: 'B'})-[:E]->(c:N {n: 'C'})", "MATCH (b:N {n: 'B'}) DELETE b")
    assert rows(s, "MATCH (a:N {n: 'A'})-[:E]->(x) RETURN labels(x), x.n") == [(None, None)]
    assert rows(s, "MATCH (a:N {n: 'A'})-[:E]->(x:N) RETURN x.n") == []
    assert rows(s, "MATCH (a:N {n: 'A'})-[:E]->(x)-[:E]->(y) RETURN y.n") == []
    assert rows(s, "MATCH (a:N {n: 'A'})-[:E*2]->(y:N) RETURN y.n") == []


def test_deleted_edges_are_skipped(spark):
    s = session(spark, "CREATE (a:N {n: 'A'})-[:E {w: 1}]->(b:N {n: 'B'})-[:E {w: 2}]->(c:N {n: 'C'})", "MATCH (a)-[e:E {w: 2}]->(b) DELETE e")
    assert values(s, "MATCH (a:N)-[:E*]->(b) RETURN b.n") == ["B"]
