"""The driver's star schema as a property graph."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import PropertyGraph
from tessera.session import ship

#: Registered queries: name to (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows where SQL can.
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def mixed(column: str | Column) -> Column:
    """Knuth's multiplicative hash of a whole number: n * 2654435761 % 2^32, in two halves of 16 bits, as the product itself passes 64 bits above 3.4 billion."""
    c = (F.col(column) if isinstance(column, str) else column).cast("bigint")
    n = lambda x: F.lit(x).cast("bigint")
    low, high = c % n(65536), (c % n(4294967296) - c % n(65536)) / n(65536)
    return (high.cast("bigint") * n(2654435761) % n(65536) * n(65536) + low * n(2654435761)) % n(4294967296)


_LABELS = [("customer", "Customer", "cus", "c_custkey", "c_name"), ("supplier", "Supplier", "sup", "s_suppkey", "s_name"), ("part", "Part", "par", "p_partkey", "p_name"), ("nation", "Nation", "nat", "n_nationkey", "n_name"), ("region", "Region", "reg", "r_regionkey", "r_name"), ("orders", "Order", "ord", "o_orderkey", None)]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, label, prefix, k, name in _LABELS:
        t = read(spark, sf_dir, table).select(key(prefix, k).alias("id"), F.lit(label).alias("type"), (F.col(name) if name else key("Order#", k)).alias("name"))
        out = t if out is None else out.unionByName(t)
    return out


def edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """src, dst, type, properties, edge_id; only the sources of the types asked for are read."""
    props = lambda *kv: F.create_map(*kv).cast("map<string,string>") if kv else F.expr("cast(map() as map<string,string>)")
    e = lambda t, s, d, kind, p, i: t.select(s.alias("src"), d.alias("dst"), F.lit(kind).alias("type"), p.alias("properties"), F.concat_ws(":", F.lit(kind), *i).alias("edge_id"))
    r = lambda t: read(spark, sf_dir, t)
    line = (F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    made = {
        "LOCATED_IN": lambda: e(r("customer"), key("cus", "c_custkey"), key("nat", "c_nationkey"), "LOCATED_IN", props(), (key("c", "c_custkey"),)).unionByName(e(r("supplier"), key("sup", "s_suppkey"), key("nat", "s_nationkey"), "LOCATED_IN", props(), (key("s", "s_suppkey"),))),
        "IN_REGION": lambda: e(r("nation"), key("nat", "n_nationkey"), key("reg", "n_regionkey"), "IN_REGION", props(), (key("", "n_nationkey"),)),
        "PLACED": lambda: e(r("orders"), key("cus", "o_custkey"), key("ord", "o_orderkey"), "PLACED", props(F.lit("term_start"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("status"), F.col("o_orderstatus")), (key("", "o_orderkey"),)),
        "CONTAINS": lambda: e(r("lineitem"), key("ord", "l_orderkey"), key("par", "l_partkey"), "CONTAINS", props(F.lit("flag"), F.col("l_returnflag")), line),
        "SUPPLIED_BY": lambda: e(r("lineitem"), key("ord", "l_orderkey"), key("sup", "l_suppkey"), "SUPPLIED_BY", props(F.lit("flag"), F.col("l_returnflag")), line),
        "SUCCEEDED": lambda: succession(r("orders")).where("type = 'SUCCEEDED'"),
        "PRECEDED": lambda: succession(r("orders")).where("type = 'PRECEDED'"),
    }
    out = None
    for kind in types or made:
        t = made[kind]()
        out = t if out is None else out.unionByName(t)
    return out


def succession(orders: DataFrame) -> DataFrame:
    """Each order to the customer's order before (SUCCEEDED) and after (PRECEDED)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = orders.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("SUCCEEDED"), F.lead("o_orderkey").over(w).alias("PRECEDED"))
    t = t.unpivot(["o_custkey", "o_orderkey"], ["SUCCEEDED", "PRECEDED"], "type", "other").where("other is not null")
    return t.select(key("ord", "o_orderkey").alias("src"), key("ord", "other").alias("dst"), "type", F.create_map(F.lit("position_id"), key("cus", "o_custkey")).alias("properties"), F.concat_ws(":", "type", F.col("o_orderkey").cast("string")).alias("edge_id"))


def graph(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> PropertyGraph:
    return PropertyGraph(nodes(spark, sf_dir), edges(spark, sf_dir, types))


#: The same in SQL: relations n (id, type, name) and e (src, dst, type).
N = """
n AS (SELECT 'cus' || c_custkey AS id, 'Customer' AS type, c_name AS name FROM customer
      UNION ALL SELECT 'sup' || s_suppkey, 'Supplier', s_name FROM supplier
      UNION ALL SELECT 'par' || p_partkey, 'Part', p_name FROM part
      UNION ALL SELECT 'nat' || n_nationkey, 'Nation', n_name FROM nation
      UNION ALL SELECT 'reg' || r_regionkey, 'Region', r_name FROM region
      UNION ALL SELECT 'ord' || o_orderkey, 'Order', 'Order#' || o_orderkey FROM orders)"""
O = """
o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS b, lead(o_orderkey) OVER w AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
E = O + """,
e AS (SELECT 'cus' || c_custkey AS src, 'nat' || c_nationkey AS dst, 'LOCATED_IN' AS type, 'LOCATED_IN:c' || c_custkey AS edge_id FROM customer
      UNION ALL SELECT 'sup' || s_suppkey, 'nat' || s_nationkey, 'LOCATED_IN', 'LOCATED_IN:s' || s_suppkey FROM supplier
      UNION ALL SELECT 'nat' || n_nationkey, 'reg' || n_regionkey, 'IN_REGION', 'IN_REGION:' || n_nationkey FROM nation
      UNION ALL SELECT 'cus' || o_custkey, 'ord' || o_orderkey, 'PLACED', 'PLACED:' || o_orderkey FROM orders
      UNION ALL SELECT 'ord' || l_orderkey, 'par' || l_partkey, 'CONTAINS', concat_ws(':', 'CONTAINS', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lineitem
      UNION ALL SELECT 'ord' || l_orderkey, 'sup' || l_suppkey, 'SUPPLIED_BY', concat_ws(':', 'SUPPLIED_BY', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lineitem
      UNION ALL SELECT 'ord' || o_orderkey, 'ord' || b, 'SUCCEEDED', 'SUCCEEDED:' || o_orderkey FROM o WHERE b IS NOT NULL
      UNION ALL SELECT 'ord' || o_orderkey, 'ord' || a, 'PRECEDED', 'PRECEDED:' || o_orderkey FROM o WHERE a IS NOT NULL)"""
