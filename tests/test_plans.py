"""The plans that Spark makes of statements, and the registered queries."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

import __spark_entry__
from propgraph import GraphSession, suite
from propgraph.operators import compiler, varpath
from propgraph.sources import shared
from propgraph.sources.tables import next_parts, star_graph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def star(spark):
    return GraphSession(star_graph(spark, DATA))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(("text", "pushed"), [
    ("MATCH (p:Part) WHERE p.size >= 40 RETURN p.name AS name", "GreaterThanOrEqual(p_size"),
    ("MATCH (p:Part {brand: 'Brand#1'}) RETURN p.key AS k", "EqualTo(p_brand,Brand#1)"),
    ("MATCH (o:SalesOrder)-[e:HAS_PART]->(p) WHERE e.qty > 45 RETURN o.key AS k", "GreaterThan(l_quantity,45.0)"),
])
def test_filters_reach_the_scan(star, text, pushed):
    assert pushed in plan(star.query(text))


def test_only_the_columns_asked_for_are_read(star):
    p = plan(star.query("MATCH (c:Customer) WHERE c.acctbal > 0 RETURN c.name AS n"))
    assert "ReadSchema: struct<c_name:string,c_acctbal:double>" in p or "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in p
    assert "c_mktsegment" not in p


def test_ends_that_are_not_read_cost_no_join(star):
    p = plan(star.query("MATCH (c:Customer)-[:PLACED]->(o) RETURN COUNT(*) AS c"))
    assert p.count("Scan parquet") == 2 and "Join" not in p  # a scan is named in the tree and in the details


def test_undirected_edges_are_read_once(star):
    p = plan(star.query("MATCH (a:Customer)-[:PLACED]-(b) RETURN id(a) AS a, id(b) AS b"))
    assert "Union" not in p


@pytest.mark.parametrize("name", ["shared_var", "correlated_prop", "correlated_product", "node_equality", "two_hop"])
def test_linked_patterns_are_no_products(star, name):
    p = plan(star.query(suite.QUERIES[name][0]))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k(star):
    assert "TakeOrderedAndProject" in plan(star.query("MATCH (c:Customer) RETURN c.name AS n ORDER BY c.acctbal LIMIT 5"))


def test_every_query_has_an_oracle():
    names = suite.queries().keys()
    assert names == suite.oracle_sql().keys() and names <= __spark_entry__.queries().keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["n", "k"]


@pytest.mark.parametrize("name", sorted(suite.QUERIES) + sorted(suite.STATES))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = suite.queries()[name](spark, DATA)
    expected = con.execute(suite.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(df.columns)

    def key(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    assert key(tuple(r) for r in df.select(*names).collect()) == key(expected.fetchall())


@pytest.mark.parametrize(("name", "least", "most"), [("var_1_3", 1, 3), ("var_min2", 2, 20), ("var_open", 1, 20)])
def test_paths_start_from_every_part(spark, name, least, most):
    """Against breadth-first search in Python from all parts."""
    edges = {}
    for a, b in next_parts(spark.read.parquet(f"{DATA}/lineitem.parquet")).collect():
        edges.setdefault(a, set()).add(b)
    expected = set()
    for (root,) in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect():
        depth, level = {root: 0}, [root]
        for d in range(1, most + 1):
            level = {b for a in level for b in edges.get(a, ())} - depth.keys()
            depth.update(dict.fromkeys(level, d))
        expected |= {(root, k) for k, d in depth.items() if least <= d}
    got = [tuple(r) for r in suite.queries()[name](spark, DATA).select("a", "b").collect()]
    assert len(got) == len(expected) and set(got) == expected


def _least_depths(edges, root, most):
    depth, level = {root: 0}, [root]
    for d in range(1, most + 1):
        level = {b for a in level for b in edges.get(a, ())} - depth.keys()
        depth.update(dict.fromkeys(level, d))
    return depth


@pytest.mark.parametrize("name", ["var_min2", "var_open"])
def test_open_paths_keep_no_pairs(spark, monkeypatch, name):
    """Before they are read, paths have cost tables of roots and edges, none of the pairs; no pair is shuffled."""
    tables = []
    for module in (varpath, compiler):
        monkeypatch.setattr(module, "written", lambda df, to, f=shared.written: tables.append(f(df, to)) or tables[-1])
    df = suite.queries()[name](spark, DATA)
    parts = spark.read.parquet(f"{DATA}/part.parquet").count()
    most = max(parts, next_parts(spark.read.parquet(f"{DATA}/lineitem.parquet")).count())
    assert df.count() > 10 * most and all(t.count() <= most for t in tables)
    assert "SortMergeJoin" not in plan(df)


@pytest.mark.parametrize("name", ["var_min2", "var_open"])
def test_open_paths_as_files(spark, tmp_path, name):
    """Pairs come in an order that files keep in a few bits each: nearly every part reaches nearly every other."""
    df = suite.queries()[name](spark, "/root/testdata/sf0.01")
    df.write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    rows = pairs.count()
    assert rows == pairs.distinct().count() > 1_000_000
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.2 * rows


@pytest.mark.parametrize(("least", "most"), [(0, 0), (0, 3), (1, 20), (2, 20)])
@pytest.mark.parametrize("small", [False, True])
def test_blocks_are_the_same_pairs(monkeypatch, least, most, small):
    """Blocks against rows of one root: no pair is twice or missing, and no row has more pairs than it may."""
    np = pytest.importorskip("numpy")
    if small:
        for name, value in (("WORDS", 1), ("NODES", 3), ("BATCH", 10)):
            monkeypatch.setattr(varpath, name, value)
    rng = np.random.default_rng(11)
    near, far = rng.integers(0, 700, (2, 1500))
    near, far = np.append(near, np.arange(700, 730)), np.append(far, np.arange(701, 731))  # a chain beside
    ids = np.arange(731) * 5 + 3
    first = np.append(0, np.cumsum(np.bincount(near, minlength=731))).astype("int32")
    far = far[np.argsort(near, kind="stable")].astype("int32")
    roots = np.append(rng.permutation(ids)[:300], [2, 9_999])
    expected = [(r, x) for t in varpath.sweep(ids, first, far, roots, least, most) for row in t.to_pylist() for r in [row["root"]] for x in row["nodes"]]
    blocks = [row for t in varpath.sweep(ids, first, far, roots, least, most, True) for row in t.to_pylist()]
    assert all(len(row["roots"]) == 1 or len(row["nodes"]) == 1 or len(row["roots"]) * len(row["nodes"]) <= varpath.NODES for row in blocks)
    assert sorted((r, x) for row in blocks for x in row["nodes"] for r in row["roots"]) == sorted(expected)
    none = np.zeros(0, "int64")
    assert sum(t.num_rows for t in varpath.sweep(none, np.zeros(1, "int32"), none.astype("int32"), roots, least, most, True)) == (len(roots) if least == 0 else 0)


@pytest.mark.parametrize("limits", [{"EDGES": -1}, {"VALUES": 0}, {"SHORT": 20}])
@pytest.mark.parametrize("text", ["MATCH (a:Part)-[:NEXT_PART*0..]->(b) RETURN a.key AS a, b.key AS b", "MATCH (a:Part)-[:NEXT_PART*2..5]-(b:Part) RETURN a.key AS a, b.key AS b"])
def test_paths_beyond_what_is_broadcast(star, monkeypatch, text, limits):
    expected = sorted(map(tuple, star.query(text).collect()))
    for name, value in limits.items():
        monkeypatch.setattr(varpath, name, value)
    assert sorted(map(tuple, star.query(text).collect())) == expected


def test_paths_lead_on_to_other_patterns(star):
    """Pairs have no estimate of their size, so that no join broadcasts them; a start that is bound twice counts twice."""
    df = star.query("MATCH (a:Part)-[:NEXT_PART*]->(b)<-[:HAS_PART]-(o) RETURN a.key AS a, b.key AS b, o.key AS o")
    pairs = star.query("MATCH (a:Part)-[:NEXT_PART*]->(b) RETURN a.key AS a, b.key AS b")
    lines = star.query("MATCH (o:SalesOrder)-[:HAS_PART]->(b:Part) RETURN b.key AS b, o.key AS o")
    assert df.count() == pairs.join(lines, "b").count()
    one = "MATCH (o:SalesOrder {key: 1})-[:HAS_PART]->(a:Part)-[:NEXT_PART*1..2]->(b) RETURN o.key AS o, a.key AS a, b.key AS b"
    starts = lines.filter("o = 1").withColumnRenamed("b", "a")
    near = star.query("MATCH (a:Part)-[:NEXT_PART*1..2]->(b) RETURN a.key AS a, b.key AS b")
    assert sorted(map(tuple, star.query(one).collect())) == sorted(map(tuple, starts.join(near, "a").select("o", "a", "b").collect()))


@pytest.mark.parametrize(("least", "most"), [(0, 0), (0, 3), (1, 20), (2, 2), (2, 20), (5, 9)])
@pytest.mark.parametrize("small", [False, True])
def test_sweep_against_single_searches(monkeypatch, least, most, small):
    """Random graphs with loops, long chains, a hub and roots without edges, in one turn and in many."""
    np = pytest.importorskip("numpy")
    if small:
        for name, value in (("WORDS", 1), ("NODES", 3), ("BATCH", 10)):
            monkeypatch.setattr(varpath, name, value)
    rng = np.random.default_rng(7)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 120, (160, 2)) * 3 + 5}
    pairs |= {(1000 + k, 1001 + k) for k in range(30)} | {(5, 400 + k) for k in range(40)} | {(8, 8)}
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    ids = np.array(sorted({x for p in pairs for x in p}), "int64")
    first = np.cumsum([0] + [len(edges.get(x, ())) for x in ids.tolist()]).astype("int32")
    far = np.array([np.searchsorted(ids, y) for x in ids.tolist() for y in edges.get(x, ())], "int32")
    roots = np.concatenate([ids, [2, 5000]])
    got = [(r, x) for t in varpath.sweep(ids, first, far, roots, least, most) for r, xs in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) for x in xs]
    expected = {(r, x) for r in roots.tolist() for x, d in _least_depths(edges, r, most).items() if least <= d}
    assert len(got) == len(expected) and set(got) == expected
    none = np.zeros(0, "int64")
    assert sum(t.num_rows for t in varpath.sweep(none, np.zeros(1, "int32"), none.astype("int32"), roots, least, most)) == (len(roots) if least == 0 else 0)


def _rows_of_joins(df):
    """The most rows that a join of the executed plan gave."""
    df.collect()
    out, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            x = x.executedPlan()
            kind = x.getClass().getSimpleName()
        if "Join" in kind:
            out.append(x.metrics().get("numOutputRows").get().value())
        if kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        todo += [x.children().apply(k) for k in range(x.children().size())]
    return max(out)


@pytest.mark.parametrize("text", [
    "MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN COUNT(*) AS c",
    "MATCH (c:Customer)-[:IN_NATION]->(n)<-[:IN_NATION]-(s:Supplier) RETURN COUNT(*) AS c, COUNT(n) AS d",
    "MATCH (c:Customer)-[:IN_NATION]->(n) MATCH (n)<-[e:IN_NATION]-(s:Supplier) RETURN COUNT(e) AS c",
])
def test_counts_make_no_pairs(star, text):
    """A node where many paths meet costs a row for each edge, not one for each pair of them."""
    df = star.query(text)
    assert _rows_of_joins(df) <= star.query("MATCH ()-[e:IN_NATION]->() RETURN COUNT(*) AS c").first()[0]
    pairs = star.query("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN c.key AS c, s.key AS s")
    assert set(df.first()) == {pairs.count()}


@pytest.mark.parametrize("pattern", [
    "(c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r), (s:Supplier)-[:IN_NATION]->(n), (m)-[:IN_REGION]->(r)",
    "(c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) WHERE c.acctbal > s.acctbal",
    "(c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) WHERE c.acctbal > 5000 AND n.name <> 'CHINA'",
    "(c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r), (s:Supplier)-[:IN_NATION]->(n)<-[:IN_NATION]-(d) WHERE s.acctbal < r.key * 1000",
    "(o)-[:HAS_PART]->(a:Part)-[:NEXT_PART*1..2]->(b)<-[:HAS_PART]-(p)",
    "(a:Part)-[:NEXT_PART]->(b)-[:NEXT_PART]->(a)",
    "(s:Supplier)-[:IN_NATION]->(n)-[:IN_REGION]->(r), (q:Region) WHERE q.key > r.key",
    "(s:Supplier)-[:IN_NATION]->(n) MATCH (x)-[:IN_REGION]->(r)<-[:IN_REGION]-(n)<-[:IN_NATION]-(y:Customer) WHERE y.acctbal > 0",
    "(s:Supplier {key: 0 - 1})-[:IN_NATION]->(n)<-[:IN_NATION]-(c)",
])
def test_counts_against_rows(star, pattern):
    """Counts, also those of values that can be null, are those of the rows that the same pattern gives."""
    rows = star.query(f"MATCH {pattern} RETURN 1 AS one").count()
    assert star.query(f"MATCH {pattern} RETURN COUNT(*) AS c").first()[0] == rows
    last = {"d": "d", "y": "y", "m)": "m", "p)": "p", "q:": "q"}
    name = next((v for k, v in last.items() if f"({k}" in pattern), "a" if "(a" in pattern else "s")
    given = star.query(f"MATCH {pattern} RETURN {name}.acctbal AS x").filter("x is not null").count()
    assert tuple(star.query(f"MATCH {pattern} RETURN COUNT({name}.acctbal) AS c, COUNT(*) AS d").first()) == (given, rows)


def test_executors_need_not_have_the_package(tmp_path):
    """What tasks of paths run is sent whole: it loads where this package cannot be imported."""
    (tmp_path / "search").write_bytes(cloudpickle.dumps(varpath._search(None, 1, 2)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "from pyspark import cloudpickle; f = cloudpickle.load(open('search', 'rb')); assert list(f([])) == []"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
