"""A property graph over the star-schema tables: nations, customers, orders, parts, suppliers, events."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import PropertyGraph

#: Lines of an order; keys of line edges are the order's key times this, plus the line's place.
LINES = 32
#: Keys of edges between parts are the first's times this, plus the second's: there is room for 267 million parts.
PARTS = 1 << 28


def line_edges(lineitem: DataFrame) -> DataFrame:
    """Lines with a key of their own: line numbers are not unique within an order, the place in a full order is."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return lineitem.withColumn("key", F.col("l_orderkey") * LINES + place)


def next_parts(lineitem: DataFrame) -> DataFrame:
    """Pairs of parts in neighbouring lines of an order, both of 30 or more: (a, b), distinct."""
    big = lineitem.filter("l_quantity >= 30").select("l_orderkey", "l_linenumber", "l_partkey")
    after = big.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    return big.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("a"), "b").distinct()


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the tables in ``sf_dir``. A table is opened when a query first reads it, for the columns it needs."""

    @cache
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def cols(df: DataFrame, **names: str) -> DataFrame:
        return df.select(*(F.expr(e).alias(n) for n, e in names.items()))

    g = PropertyGraph(spark)

    def nodes(label: str, df: Callable[[], DataFrame], **names: str) -> None:
        nonlocal g
        key = names["key"]
        g = g.add_nodes(label, lambda: cols(df(), _key=key, key=f"bigint({key})", **{k: v for k, v in names.items() if k != "key"}), "_key", ["key", *names])

    def edges(label: str, df: Callable[[], DataFrame], source: tuple[str, str], target: tuple[str, str], key: str, **names: str) -> None:
        nonlocal g
        g = g.add_edges(label, lambda: cols(df(), _key=key, _from=source[1], _to=target[1], **names), (source[0], "_from"), (target[0], "_to"), "_key", names)

    nodes("Region", lambda: t("region"), key="r_regionkey", name="r_name")
    nodes("Nation", lambda: t("nation"), key="n_nationkey", name="n_name")
    nodes("Customer", lambda: t("customer"), key="c_custkey", name="c_name", acctbal="c_acctbal", segment="c_mktsegment")
    nodes("Supplier", lambda: t("supplier"), key="s_suppkey", name="s_name", acctbal="s_acctbal")
    nodes("Part", lambda: t("part"), key="p_partkey", name="p_name", brand="p_brand", ptype="p_type", size="p_size", price="p_retailprice")
    nodes("SalesOrder", lambda: t("orders"), key="o_orderkey", status="o_orderstatus", totalprice="o_totalprice", priority="o_orderpriority", odate="string(o_orderdate)")
    nodes("User", lambda: t("events").select("user_id").distinct(), key="user_id")
    nodes("Event", lambda: t("events"), key="event_id", etype="event_type", value="value", ts="string(ts)")
    edges("IN_REGION", lambda: t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey")
    edges("IN_NATION", lambda: t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey * 2")
    edges("IN_NATION", lambda: t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey * 2 + 1")
    edges("PLACED", lambda: t("orders"), ("Customer", "o_custkey"), ("SalesOrder", "o_orderkey"), "o_orderkey")
    # edges whose keys no query reads cost no window: columns that are not asked for are pruned
    edges("HAS_PART", lambda: line_edges(t("lineitem")), ("SalesOrder", "l_orderkey"), ("Part", "l_partkey"), "key", qty="l_quantity", price="l_extendedprice", discount="l_discount", flag="l_returnflag")
    edges("FROM_SUPPLIER", lambda: line_edges(t("lineitem")), ("SalesOrder", "l_orderkey"), ("Supplier", "l_suppkey"), "key", qty="l_quantity")
    edges("NEXT_PART", lambda: next_parts(t("lineitem")), ("Part", "a"), ("Part", "b"), f"a * {PARTS} + b")
    edges("PERFORMED", lambda: t("events"), ("User", "user_id"), ("Event", "event_id"), "event_id")
    return g
