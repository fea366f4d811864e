"""The star schema as a property graph, in Spark and in SQL.

region -> nation and nation -> customer, supplier are Contains 1.0; customer -> order is Calls 0.7; order -> part is
Imports 1 - l_discount and order -> supplier References 1 - l_tax, one edge for each line item, so equal keys fuse.
A node's name is table:key and its address the hash of the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.identity import address_of
from cairn.operators.graph import Graph
from cairn.schema import node_columns, provenance

_NAMED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "order": "o_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relation, confidence) by node names, unfused."""
    t = lambda n: table(spark, sf_dir, n)
    part = lambda df, s, d, rel, c: df.select(s.alias("source"), d.alias("target"), F.lit(rel).alias("relation"), c.alias("confidence"))
    one = F.lit(1.0)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    parts = [
        part(t("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "Contains", one),
        part(t("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "Contains", one),
        part(t("supplier"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "Contains", one),
        part(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "Calls", F.lit(0.7)),
        part(line, _id("order", "l_orderkey"), _id("part", "l_partkey"), "Imports", 1 - F.col("l_discount")),
        part(line, _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "References", 1 - F.col("l_tax")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fused_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.operators.fusion import fuse_confidence

    return fuse_confidence(raw_edges(spark, sf_dir)).drop("n")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows by name, in the stored schema; the address is the name itself, so that results can be read."""
    out = None
    for kind, key in _NAMED.items():
        own = table(spark, sf_dir, "orders" if kind == "order" else kind).select(_id(kind, key).alias("id"))
        out = own if out is None else out.unionByName(own)
    return out.select(*node_columns(F.col("id"), "Symbol", address_of("id"), None, provenance()))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), fused_edges(spark, sf_dir))


#: The same as SQL, as common table expressions.
RAW_SQL = """raw AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'Contains' AS relation, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains', 1.0::DOUBLE FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'Contains', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'Calls', 0.7::DOUBLE FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'Imports', 1 - l_discount FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'References', 1 - l_tax FROM lineitem)"""
EDGES_SQL = (
    RAW_SQL
    + """, edges AS (SELECT source, target, relation,
    CASE WHEN count(*) = 1 THEN min(confidence) ELSE 1 - product(1 - greatest(0, least(1, confidence))) END AS confidence, count(*) AS n
  FROM raw GROUP BY source, target, relation)"""
)
NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey FROM part UNION ALL SELECT 'order:' || o_orderkey FROM orders)"""
