"""The registered graph queries, each with the same result in DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConflictError
from .session import GraphSession, GraphStore
from .sources import files
from .sources.catalog import PropertyGraph
from .sources.shared import new_path
from .sources.tables import star_graph

NEXT_PART = "next_part as (select distinct a.l_partkey as a, b.l_partkey as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity >= 30 and b.l_quantity >= 30)"
PARTS = "from part"


def _node(tag: int, key: str) -> str:
    return f"(({tag}::bigint << 56) | {key}::bigint)"


def _paths(least: int, most: int, where: str, edges: str = "select a, b from next_part") -> str:
    """Nodes by least depth, from all parts, over at most ``most`` hops; each root and node once."""
    return f"""with recursive {NEXT_PART}, e as ({edges}),
        r(root, node, depth) as (select p_partkey, p_partkey, 0 from part union select r.root, e.b, r.depth + 1 from r join e on e.a = r.node where r.depth < {most}),
        d as (select root, node, min(depth) as depth from r group by root, node)
        select root as a, node as b from d where depth between {least} and {most} {where}"""


#: name -> (statement, the same in SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "node_scan_label": ("MATCH (n:Nation) RETURN n.name AS name", "select n_name as name from nation"),
    "node_scan_all_count": ("MATCH (n) RETURN COUNT(*) AS c", "select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(*) from events) + (select count(distinct user_id) from events) as c"),
    "node_scan_all_labels": ("MATCH (n) WHERE n.acctbal > 9000 RETURN labels(n) AS l, n.name AS name", "select 'Customer' as l, c_name as name from customer where c_acctbal > 9000 union all select 'Supplier', s_name from supplier where s_acctbal > 9000"),
    "node_scan_unknown_label": ("MATCH (n:Nowhere) RETURN COUNT(*) AS c", "select 0::bigint as c"),
    "project_expr": ("MATCH (p:Part) RETURN p.name AS name, p.size + 1 AS s1", "select p_name as name, p_size::bigint + 1 as s1 from part"),
    "filter_cmp": ("MATCH (p:Part) WHERE p.size >= 40 RETURN p.name AS name, p.size AS size", "select p_name as name, p_size::bigint as size from part where p_size >= 40"),
    "filter_mixed_numbers": ("MATCH (p:Part) WHERE p.size < 10.5 AND p.price >= 1000 RETURN p.key AS k", "select p_partkey as k from part where p_size < 10.5 and p_retailprice >= 1000"),
    "filter_and_or_not": ("MATCH (p:Part) WHERE NOT p.size > 10 OR (p.brand = 'Brand#1' AND p.size <> 20) RETURN p.key AS k", "select p_partkey as k from part where not p_size > 10 or (p_brand = 'Brand#1' and p_size <> 20)"),
    "inline_prop": ("MATCH (p:Part {brand: 'Brand#1'}) RETURN p.key AS k, p.name AS name", "select p_partkey as k, p_name as name from part where p_brand = 'Brand#1'"),
    "null_eq": ("MATCH (p:Part) WHERE p.nope = NULL RETURN p.key AS k", "select p_partkey as k from part"),
    "null_neq": ("MATCH (p:Part) WHERE p.nope <> 1 RETURN p.key AS k", "select p_partkey as k from part"),
    "null_or_strict": ("MATCH (p:Part) WHERE p.nope > 1 OR p.size > 0 RETURN COUNT(*) AS c", "select 0::bigint as c"),
    "null_and_strict": ("MATCH (p:Part) RETURN (p.nope > 1 AND FALSE) OR TRUE AS x LIMIT 1", "select cast(null as boolean) as x"),
    "not_null_true": ("MATCH (p:Part) WHERE NOT p.nope > 1 RETURN COUNT(*) AS c", "select count(*) as c from part"),
    "null_sparse": ("MATCH (n) WHERE NOT n.size > 10 RETURN labels(n) AS l", "select 'Region' as l from region union all select 'Nation' from nation union all select 'Customer' from customer union all select 'Supplier' from supplier union all select 'SalesOrder' from orders union all select 'Event' from events union all select 'User' from (select distinct user_id from events) union all select 'Part' from part where p_size <= 10"),
    "mixed_kinds": ("MATCH (p:Part) WHERE p.size <= 'x' AND NOT p.size < 'x' AND p.size <> 'x' RETURN COUNT(*) AS c", "select count(*) as c from part"),
    "truthy_int": ("MATCH (p:Part) WHERE p.size % 2 RETURN p.key AS k", "select p_partkey as k from part where p_size % 2 <> 0"),
    "truthy_string": ("MATCH (p:Part) WHERE p.name AND p.size RETURN COUNT(*) AS c", "select count(*) as c from part where p_name <> '' and p_size <> 0"),
    "is_null": ("MATCH (n) WHERE n.name IS NULL RETURN COUNT(*) AS c", "select (select count(*) from orders) + (select count(*) from events) + (select count(distinct user_id) from events) as c"),
    "is_not_null": ("MATCH (n) WHERE n.name IS NOT NULL RETURN n.name AS name", "select r_name as name from region union all select n_name from nation union all select c_name from customer union all select s_name from supplier union all select p_name from part"),
    "str_contains": ("MATCH (p:Part) WHERE p.name CONTAINS 'ed' RETURN p.key AS k", "select p_partkey as k from part where contains(p_name, 'ed')"),
    "str_starts": ("MATCH (p:Part) WHERE p.name STARTS WITH 's' RETURN p.key AS k", "select p_partkey as k from part where starts_with(p_name, 's')"),
    "str_ends": ("MATCH (p:Part) WHERE p.name ENDS WITH 'g' RETURN p.key AS k", "select p_partkey as k from part where ends_with(p_name, 'g')"),
    "arith_all": ("MATCH (p:Part) RETURN p.key AS k, p.size - 1 AS a, p.size * 2 AS b, p.size / 3 AS c, (0 - p.size) / 3 AS d, p.size % 3 AS e, -p.size AS f, (0 - p.size) % 3 AS g", "select p_partkey as k, p_size::bigint - 1 as a, p_size::bigint * 2 as b, p_size::bigint // 3 as c, -(p_size::bigint // 3) as d, p_size::bigint % 3 as e, -p_size::bigint as f, -(p_size::bigint % 3) as g from part"),
    "arith_float": ("MATCH (p:Part) RETURN p.key AS k, p.size / 4.0 AS a, p.size + 0.5 AS b, p.size % 2.5 AS c", "select p_partkey as k, p_size / 4.0::double as a, p_size + 0.5::double as b, p_size % 2.5::double as c from part"),
    "fn_id": ("MATCH (n:Part) RETURN id(n) AS i", f"select {_node(5, 'p_partkey')} as i from part"),
    "fn_labels": ("MATCH (n:Part) RETURN DISTINCT labels(n) AS l", "select 'Part' as l"),
    "fn_type": ("MATCH (c:Customer)-[e]->(x) RETURN DISTINCT type(e) AS t", "select * from (values ('IN_NATION'), ('PLACED')) v(t)"),
    "fn_to_string": ("MATCH (p:Part) RETURN p.key AS k, toString(p.size) AS s, toString(p.nope) AS n, toString(TRUE) AS b, toString(2.0) AS f, toString(0.5) AS g", "select p_partkey as k, p_size::varchar as s, 'NULL' as n, 'true' as b, '2' as f, '0.5' as g from part"),
    "fn_to_integer": ("MATCH (p:Part) RETURN p.key AS k, toInteger(p.price) AS a, toInteger('42') AS b, toInteger(TRUE) AS c, toInteger(p.nope) AS d", "select p_partkey as k, trunc(p_retailprice)::bigint as a, 42::bigint as b, 1::bigint as c, cast(null as bigint) as d from part"),
    "fn_to_float": ("MATCH (p:Part) RETURN p.key AS k, toFloat(p.size) AS a, toFloat('3.25') AS b", "select p_partkey as k, p_size::double as a, 3.25::double as b from part"),
    "literals": ("RETURN 1 AS i, 2.5 AS f, 'a\\'b' AS s, TRUE AS b, NULL IS NULL AS n", "select 1::bigint as i, 2.5::double as f, 'a''b' as s, true as b, true as n"),
    "precedence": ("RETURN 1 + 2 * 3 - 4 / 2 AS a, NOT 1 = 2 AND 2 > 1 OR FALSE AS b", "select 5::bigint as a, true as b"),
    "order_asc_desc": ("MATCH (c:Customer) RETURN c.name AS name ORDER BY c.acctbal DESC, c.name LIMIT 10", "select c_name as name from customer order by c_acctbal desc, c_name limit 10"),
    "order_alias": ("MATCH (c:Customer) RETURN c.key + 1 AS k ORDER BY k DESC LIMIT 7", "select c_custkey + 1 as k from customer order by k desc limit 7"),
    "order_nulls": ("MATCH (n) RETURN n.size AS s, id(n) AS i ORDER BY n.size, id(n) LIMIT 12", f"select cast(null as bigint) as s, i from (select {_node(1, 'r_regionkey')} as i from region union all select {_node(2, 'n_nationkey')} from nation) order by i limit 12"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.name AS name ORDER BY c.name SKIP 20 LIMIT 10", "select c_name as name from customer order by c_name limit 10 offset 20"),
    "limit_before_agg": ("MATCH (p:Part) RETURN COUNT(*) AS c LIMIT 5", "select count(*) as c from (select * from part limit 5)"),
    "limit_before_distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS b ORDER BY p.name, id(p) LIMIT 50", "select distinct p_brand as b from (select p_brand from part order by p_name, p_partkey limit 50)"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS b, p.ptype AS t", "select distinct p_brand as b, p_type as t from part"),
    "agg_all": ("MATCH (p:Part) RETURN COUNT(*) AS c, SUM(p.size) AS s, AVG(p.size) AS a, MIN(p.size) AS mn, MAX(p.size) AS mx", "select count(*) as c, sum(p_size)::double as s, avg(p_size) as a, min(p_size)::double as mn, max(p_size)::double as mx from part"),
    "agg_count_expr": ("MATCH (p:Part) RETURN COUNT(p.nope) AS c, COUNT(p) AS d, COUNT(p.name) AS e", "select 0::bigint as c, count(*) as d, count(p_name) as e from part"),
    "agg_empty": ("MATCH (p:Part) WHERE p.size > 9999 RETURN SUM(p.size) AS s, AVG(p.size) AS a, MIN(p.size) AS m, COUNT(*) AS c", "select 0.0::double as s, cast(null as double) as a, cast(null as double) as m, 0::bigint as c"),
    "agg_min_string": ("MATCH (p:Part) RETURN MIN(p.name) AS m, SUM(p.name) AS s", "select cast(null as double) as m, 0.0::double as s"),
    "agg_skips_errors": ("MATCH (p:Part) RETURN SUM(100 / (p.size - p.size % 2)) AS s", "select coalesce(sum(100 // nullif(p_size - p_size % 2, 0)), 0)::double as s from part"),
    "hop_out": ("MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) RETURN c.name AS name, o.key AS k", "select c_name as name, o_orderkey as k from customer join orders on o_custkey = c_custkey"),
    "hop_in": ("MATCH (o:SalesOrder)<-[:PLACED]-(c) WHERE o.totalprice > 1000 RETURN o.key AS k, c.key AS c", "select o_orderkey as k, o_custkey as c from orders where o_totalprice > 1000"),
    "hop_any": ("MATCH (a:Part)-[:NEXT_PART]-(b:Part) RETURN a.key AS a, b.key AS b", f"with {NEXT_PART} select a, b from next_part union all select b, a from next_part"),
    "hop_any_label": ("MATCH (c:Customer)-[e]->(x) RETURN COUNT(*) AS c", "select (select count(*) from orders) + (select count(*) from customer) as c"),
    "edge_prop": ("MATCH (o:SalesOrder)-[e:HAS_PART]->(p:Part) WHERE e.qty > 45 RETURN o.key AS o, p.key AS p, e.qty AS q, e.flag AS f", "select l_orderkey as o, l_partkey as p, l_quantity as q, l_returnflag as f from lineitem where l_quantity > 45"),
    "edge_filter": ("MATCH (o)-[:HAS_PART {qty: 50.0}]->(p) RETURN COUNT(*) AS c", "select count(*) as c from lineitem where l_quantity = 50"),
    "two_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN c.key AS k, n.name AS n, r.name AS r", "select c_custkey as k, n_name as n, r_name as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "three_hop": ("MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o) RETURN n.name AS n, o.key AS k", "select n_name as n, o_orderkey as k from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where r_name = 'ASIA'"),
    "hop_repeats": ("MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b) RETURN a.key AS a, b.key AS b", "select a.n_nationkey::bigint as a, b.n_nationkey::bigint as b from nation a join nation b using (n_regionkey)"),
    "cartesian": ("MATCH (r:Region), (n:Nation) RETURN r.name AS r, n.name AS n", "select r_name as r, n_name as n from region cross join nation"),
    "theta_join": ("MATCH (c:Customer), (s:Supplier) WHERE c.acctbal < s.acctbal AND s.acctbal > 9000 RETURN COUNT(*) AS c", "select count(*) as c from customer join supplier on c_acctbal < s_acctbal where s_acctbal > 9000"),
    "shared_var": ("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN COUNT(*) AS c", "select count(*) as c from customer join supplier on c_nationkey = s_nationkey"),
    "shared_var_loop": ("MATCH (a:Part)-[:NEXT_PART]->(a) RETURN a.key AS k", f"with {NEXT_PART} select a as k from next_part where a = b"),
    "second_match": ("MATCH (c:Customer) WHERE c.acctbal > 9500 MATCH (c)-[:PLACED]->(o) RETURN c.key AS c, o.key AS o", "select c_custkey as c, o_orderkey as o from customer join orders on o_custkey = c_custkey where c_acctbal > 9500"),
    "correlated_prop": ("MATCH (a:Part)-[:NEXT_PART]->(b:Part {brand: a.brand}) RETURN a.key AS a, b.key AS b", f"with {NEXT_PART} select a, b from next_part join part p on p.p_partkey = a join part q on q.p_partkey = b where p.p_brand = q.p_brand"),
    "correlated_product": ("MATCH (c:Customer), (s:Supplier {acctbal: c.acctbal}) RETURN COUNT(*) AS c", "select count(*) as c from customer join supplier on c_acctbal = s_acctbal"),
    "node_equality": ("MATCH (a:Nation), (b:Nation) WHERE a = b RETURN COUNT(*) AS c", "select count(*) as c from nation"),
    "anon_start": ("MATCH (:Region {name: 'EUROPE'})<-[:IN_REGION]-(n) RETURN n.name AS n", "select n_name as n from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'"),
    "fan_out": ("MATCH (u:User)-[:PERFORMED]->(e:Event) WHERE e.value > 50 RETURN u.key AS u, e.etype AS t", "select user_id as u, event_type as t from events where value > 50"),
    "supplier_edges": ("MATCH (o:SalesOrder)-[e:FROM_SUPPLIER]->(s:Supplier) WHERE s.acctbal < 0 RETURN COUNT(*) AS c, SUM(e.qty) AS q", "select count(*) as c, coalesce(sum(l_quantity), 0)::double as q from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal < 0"),
    "var_1_3": ("MATCH (a:Part)-[:NEXT_PART*1..3]->(b:Part) RETURN a.key AS a, b.key AS b", _paths(1, 3, "")),
    "var_exact2": ("MATCH (a:Part)-[:NEXT_PART*2]->(b) RETURN a.key AS a, b.key AS b", _paths(2, 2, "")),
    "var_0_2": ("MATCH (a:Part)-[:NEXT_PART*0..2]->(b) RETURN a.key AS a, b.key AS b", _paths(0, 2, "")),
    "var_min2": ("MATCH (a:Part)-[:NEXT_PART*2..]->(b) RETURN a.key AS a, b.key AS b", _paths(2, 20, "")),
    "var_open": ("MATCH (a:Part)-[:NEXT_PART*]->(b) RETURN a.key AS a, b.key AS b", _paths(1, 20, "")),
    "var_upto": ("MATCH (a:Part)-[:NEXT_PART*..2]->(b) RETURN a.key AS a, b.key AS b", _paths(1, 2, "")),
    "var_in": ("MATCH (a:Part)<-[:NEXT_PART*1..2]-(b) RETURN a.key AS a, b.key AS b", _paths(1, 2, "", "select b as a, a as b from next_part")),
    "var_any": ("MATCH (a:Part)-[:NEXT_PART*1..2]-(b) RETURN a.key AS a, b.key AS b", _paths(1, 2, "", "select a, b from next_part union select b, a from next_part")),
    "var_label": ("MATCH (n:Nation)-[*1..2]-(c:Supplier) RETURN n.key AS n, c.key AS c", "select n, c from (select n_nationkey::bigint as n, s_suppkey as c from nation join supplier on s_nationkey = n_nationkey)"),
}

# -- writes: each on a session of its own; the result is the state after them ---------------------------------------


def _small(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A session on regions and nations, which is enough for writes."""
    g = star_graph(spark, sf_dir)
    for label in ("Customer", "Supplier", "Part", "SalesOrder", "User", "Event"):
        g = PropertyGraph(spark, {k: t for k, t in g.nodes.items() if k != label}, {k: t for k, t in g.edges.items() if k == "IN_REGION"}, g.tags)
    return GraphSession(g)


def create_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    s.query("CREATE (r:Region {name: 'ATLANTIS', key: 100})")
    s.query("MATCH (r:Region {name: 'ASIA'}) CREATE (x:Region {name: r.name, key: r.key + 200})")
    return s.query("MATCH (r:Region) RETURN r.name AS name, r.key AS k")


def create_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    s.query("MATCH (a:Nation), (r:Region) WHERE a.key = 1 AND r.key = 0 CREATE (a)-[:VISITS {days: 3}]->(r)")
    s.query("MATCH (a:Nation {key: 2}), (r:Region {key: 1}) CREATE (r)<-[:VISITS {days: 4}]-(a)")
    return s.query("MATCH (a:Nation)-[v:VISITS]->(r:Region) RETURN a.key AS a, v.days AS d, r.key AS r")


def create_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    s.query("CREATE (a:City {name: 'A'})-[:ROAD {km: 5}]->(b:City {name: 'B'})<-[:ROAD {km: 7}]-(c:City {name: 'C'})")
    return s.query("MATCH (x:City)-[r:ROAD]->(y:City) RETURN x.name AS x, r.km AS km, y.name AS y")


def set_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    s.query("MATCH (n:Nation) WHERE n.key < 5 SET n.name = 'X', n.rank = n.key * 10, n.rank = n.rank + 1")
    return s.query("MATCH (n:Nation) RETURN n.key AS k, n.name AS name, n.rank AS r")


def set_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    s.query("MATCH (n:Nation)-[e:IN_REGION]->(r:Region {key: 1}) SET e.since = 1990 + n.key")
    return s.query("MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN n.key AS k, e.since AS since")


def delete_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a deleted node stay: the far end is bound without label and properties."""
    s = _small(spark, sf_dir)
    s.query("MATCH (r:Region) WHERE r.key = 1 DELETE r")
    return s.query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.key AS k, labels(r) AS l, r.name AS name")


def delete_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    s.query("MATCH (n:Nation)-[e:IN_REGION]->(r:Region {key: 1}) DELETE e")
    return s.query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.key AS n, r.key AS r")


def tx_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    with s.transaction() as tx:
        tx.query("MATCH (r:Region {key: 0}) SET r.name = 'FIRST'")
        seen = tx.query("MATCH (r:Region {name: 'FIRST'}) RETURN COUNT(*) AS c").first()[0]
        before = s.query("MATCH (r:Region {name: 'FIRST'}) RETURN COUNT(*) AS c").first()[0]
    after = s.query("MATCH (r:Region {name: 'FIRST'}) RETURN COUNT(*) AS c").first()[0]
    return spark.createDataFrame([(seen, before, after)], "own long, others long, committed long")


def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    tx = s.begin()
    tx.query("MATCH (r:Region) SET r.name = 'GONE'")
    tx.query("MATCH (n:Nation) DELETE n")
    tx.rollback()
    return s.query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.name AS n, r.name AS r")


def tx_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    a, b, c = s.begin(), s.begin(), s.begin()
    a.query("MATCH (r:Region {key: 0}) SET r.v = 1")
    b.query("MATCH (r:Region {key: 0}) SET r.v = 2")
    c.query("MATCH (r:Region {key: 1}) SET r.v = 3")
    a.commit()
    try:
        b.commit()
        failed = False
    except ConflictError:
        failed = True
    c.commit()
    return s.query("MATCH (r:Region) WHERE r.v IS NOT NULL RETURN r.key AS k, r.v AS v").withColumn("failed", F.lit(failed))


def save_and_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _small(spark, sf_dir)
    path = new_path(spark, "saved")
    files.save(s.graph, path)
    s.query("MATCH (n:Nation {key: 0}) SET n.name = 'SAVED'")
    files.save(s.graph, path, s.store.next_id)
    graph, first = files.load(spark, path)
    return GraphSession(GraphStore(graph, first_id=first)).query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.name AS n, r.name AS r")


def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary's change log, followed by a replica that began with the same graph; the replica's state."""
    from .streaming.changelog import ChangeLog, replicate

    s = _small(spark, sf_dir)
    log = ChangeLog(spark, new_path(spark, "changes"), s.store.graph_id)
    s.store.log = log
    replica = GraphStore(s.graph)
    s.query("CREATE (a:City {name: 'A', pop: 1})-[:ROAD {km: 2.5}]->(b:City {name: 'B'})")
    s.query("MATCH (n:Nation) WHERE n.key < 3 SET n.name = 'X'")
    tx = s.begin()
    tx.query("MATCH (n:Nation) SET n.name = 'LOST'")
    tx.rollback()
    s.query("MATCH (n:Nation {key: 24}) DELETE n")
    r = replicate(log, replica, new_path(spark, "replica"))
    r.apply(log.read())  # once more: nothing changes
    out = GraphSession(r.store, read_only=True)
    cities = out.query("MATCH (a:City)-[e:ROAD]->(b:City) RETURN a.name AS a, toString(e.km) AS b")
    return cities.unionByName(out.query("MATCH (n:Nation) RETURN n.name AS a, toString(n.key) AS b"))


def distinct_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows in the order of a property that is not returned, with their places."""
    out = GraphSession(star_graph(spark, sf_dir)).query("MATCH (c:Customer) RETURN DISTINCT c.segment AS s ORDER BY c.acctbal DESC")
    return spark.createDataFrame([(r["s"], k) for k, r in enumerate(out.collect(), 1)], "s string, place long")  # five segments


def set_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer sets its nation's property; the last one's value stays."""
    s = GraphSession(star_graph(spark, sf_dir))
    s.query("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) SET n.last = c.key")
    return s.query("MATCH (n:Nation) RETURN n.key AS n, n.last AS c")


def set_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = GraphSession(star_graph(spark, sf_dir))
    s.query("MATCH (c:Customer) WHERE c.acctbal < 0 SET c.segment = 'DEBT', c.owed = -c.acctbal")
    return s.query("MATCH (c:Customer) RETURN c.key AS k, c.segment AS s, c.owed AS owed")


def delete_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = GraphSession(star_graph(spark, sf_dir))
    s.query("MATCH (o:SalesOrder) WHERE o.status = 'F' DELETE o")
    return s.query("MATCH (c:Customer)-[:PLACED]->(o) RETURN c.key AS c, labels(o) AS l")


def create_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = GraphSession(star_graph(spark, sf_dir))
    s.query("MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) CREATE (c)-[:OWES {amount: o.totalprice}]->(b:Bill {of: o.key})")
    return s.query("MATCH (c:Customer)-[e:OWES]->(b:Bill) RETURN c.key AS c, b.of AS o, e.amount AS a")


def flush_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph in files, changed, saved again and opened."""
    s, path = GraphSession(star_graph(spark, sf_dir)), new_path(spark, "flushed")
    s.query("MATCH (p:Part) WHERE p.size > 25 SET p.brand = 'LARGE'")
    s.flush(path)
    graph, first = files.load(spark, path)
    return GraphSession(GraphStore(graph, first_id=first)).query("MATCH (o:SalesOrder)-[:HAS_PART]->(p:Part) RETURN o.key AS o, p.key AS p, p.brand AS b")


def _logged(spark: SparkSession, s: GraphSession):
    from .streaming.changelog import ChangeLog

    s.store.log = ChangeLog(spark, new_path(spark, "changes"), s.store.graph_id)
    return s.store.log


def stream_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change to all customers by way of the log; the replica is opened anew between its two batches."""
    from .streaming.changelog import Replica

    s = GraphSession(star_graph(spark, sf_dir))
    base = GraphStore(s.graph)
    log, path = _logged(spark, s), new_path(spark, "replica")
    s.query("MATCH (c:Customer) SET c.rank = c.key % 3")
    first = Replica(base, log.graph_id, path)
    first.apply(log.read())
    s.query("MATCH (c:Customer) WHERE c.acctbal < 0 DELETE c")
    again = Replica(GraphStore(PropertyGraph(spark)), log.graph_id, path)
    again.apply(log.read())
    return GraphSession(again.store, read_only=True).query("MATCH (c:Customer) RETURN c.key AS k, c.rank AS r, c.segment AS s")


def replica_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a replica, and that it stays stopped after a restart; numbers after a restart of the log."""
    from .errors import CorruptLogError
    from .streaming.changelog import BLOCK, ChangeLog, Replica

    s = _small(spark, sf_dir)
    log = _logged(spark, s)
    s.query("MATCH (n:Nation) SET n.name = 'X'")
    path = new_path(spark, "replica")

    def stops(replica, rows) -> bool:
        try:
            replica.apply(rows)
        except CorruptLogError:
            return True
        return False

    rows = log.read()
    found = [
        ("bad checksum", stops(Replica(GraphStore(s.graph), log.graph_id, path), rows.withColumn("crc", F.col("crc") + 1))),
        ("still stopped", stops(Replica(GraphStore(s.graph), log.graph_id, path), rows)),
        ("other graph", stops(Replica(GraphStore(s.graph), "another"), rows)),
        ("other columns", stops(Replica(GraphStore(s.graph), log.graph_id), rows.drop("body"))),
        ("sound rows", stops(Replica(GraphStore(s.graph), log.graph_id), rows)),
        ("numbers once", rows.count() == rows.select("lsn").distinct().count()),
        ("new block", ChangeLog(spark, log.path, log.graph_id).next_lsn == BLOCK + 1),
    ]
    return spark.createDataFrame(found, "what string, so boolean")


def admin_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW commands and promotion on a primary and a replica; comments and letters of either case in statements."""
    from .errors import ReadOnlyError

    s = _small(spark, sf_dir)
    r = GraphSession(s.store, read_only=True)

    def only_reads(session) -> bool:
        try:
            session.query("MATCH (n:Nation {key: 0}) SET n.seen = 1")
        except ReadOnlyError:
            return True
        return False

    found = [
        ("role", s.query("SHOW REPLICATION STATUS").first()["role"]), ("role of a replica", r.query("show replication status;").first()["role"]),
        ("replicas", str(s.query("SHOW REPLICAS").count())), ("lag", str(s.query("SHOW REPLICATION LAG").count())),
        ("shards", ",".join(sorted({x["status"] for x in s.query("SHOW SHARD STATUS").collect()}))),
        ("only reads", str(only_reads(r))), ("promoted", r.query("PROMOTE REPLICA").columns[0]), ("writes", str(only_reads(r))),
        ("comments", str(s.query("match (N:Nation) // all nations\n return count(*) as c").first()["c"])),
    ]
    return spark.createDataFrame(found, "what string, is string")


STATES: dict[str, tuple] = {
    "distinct_order": (distinct_order, "select s, row_number() over (order by m desc) as place from (select c_mktsegment as s, max(c_acctbal) as m from customer group by 1)"),
    "set_last": (set_last, "select n_nationkey::bigint as n, max(c_custkey) as c from nation left join customer on c_nationkey = n_nationkey group by 1"),
    "set_customers": (set_customers, "select c_custkey as k, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end as s, case when c_acctbal < 0 then -c_acctbal end as owed from customer"),
    "delete_orders": (delete_orders, "select o_custkey as c, case when o_orderstatus <> 'F' then 'SalesOrder' end as l from orders"),
    "create_orders": (create_orders, "select o_custkey as c, o_orderkey as o, o_totalprice as a from orders"),
    "flush_whole": (flush_whole, "select l_orderkey as o, l_partkey as p, case when p_size > 25 then 'LARGE' else p_brand end as b from lineitem join part on l_partkey = p_partkey"),
    "stream_customers": (stream_customers, "select c_custkey as k, c_custkey % 3 as r, c_mktsegment as s from customer where c_acctbal >= 0"),
    "replica_checks": (replica_checks, "select * from (values ('bad checksum', true), ('still stopped', true), ('other graph', true), ('other columns', true), ('sound rows', false), ('numbers once', true), ('new block', true)) v(what, so)"),
    "admin_commands": (admin_commands, "select what, \"is\" from (values ('role', 'primary'), ('role of a replica', 'replica'), ('replicas', '0'), ('lag', '0'), ('shards', 'running'), ('only reads', 'True'), ('promoted', 'message'), ('writes', 'False'), ('comments', '25')) v(what, \"is\")"),
    "create_node": (create_node, "select r_name as name, r_regionkey::bigint as k from region union all select 'ATLANTIS', 100 union all select r_name, r_regionkey + 200 from region where r_name = 'ASIA'"),
    "create_edge": (create_edge, "select * from (values (1::bigint, 3::bigint, 0::bigint), (2, 4, 1)) v(a, d, r)"),
    "create_path": (create_path, "select * from (values ('A', 5::bigint, 'B'), ('C', 7, 'B')) v(x, km, y)"),
    "set_prop": (set_prop, "select n_nationkey::bigint as k, case when n_nationkey < 5 then 'X' else n_name end as name, case when n_nationkey < 5 then n_nationkey::bigint * 10 + 1 end as r from nation"),
    "set_edge": (set_edge, "select n_nationkey::bigint as k, case when n_regionkey = 1 then 1990::bigint + n_nationkey end as since from nation"),
    "delete_node": (delete_node, "select n_nationkey::bigint as k, case when n_regionkey <> 1 then 'Region' end as l, case when n_regionkey <> 1 then r_name end as name from nation join region on n_regionkey = r_regionkey"),
    "delete_edge": (delete_edge, "select n_nationkey::bigint as n, n_regionkey::bigint as r from nation where n_regionkey <> 1"),
    "tx_commit": (tx_commit, "select 1::bigint as own, 0::bigint as others, 1::bigint as committed"),
    "tx_rollback": (tx_rollback, "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey"),
    "tx_conflict": (tx_conflict, "select * from (values (0::bigint, 1::bigint, true), (1, 3, true)) v(k, v, failed)"),
    "save_and_open": (save_and_open, "select case when n_nationkey = 0 then 'SAVED' else n_name end as n, r_name as r from nation join region on n_regionkey = r_regionkey"),
    "stream_apply": (stream_apply, "select 'A' as a, '2.5' as b union all select case when n_nationkey < 3 then 'X' else n_name end, n_nationkey::varchar from nation where n_nationkey <> 24"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: three hops with a filter on the far end, and properties of both."""
    return GraphSession(star_graph(spark, sf_dir)).query(QUERIES["three_hop"][0])


def queries() -> dict:
    def run(text: str):
        return lambda spark, sf_dir: GraphSession(star_graph(spark, sf_dir)).query(text)

    return {name: run(text) for name, (text, _) in QUERIES.items()} | {name: f for name, (f, _) in STATES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()} | {name: sql for name, (_, sql) in STATES.items()}
