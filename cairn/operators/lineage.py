"""Lineage of mutations: child -> parent edges of relation MutatedFrom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.fixpoint import breadth_first
from cairn.schema import edge_columns, provenance


def record_mutations(records: DataFrame) -> DataFrame:
    """Edges of (parent, child, actor, timestamp) rows."""
    prov = provenance("ToolOutput", F.col("actor"), F.col("timestamp"))
    return records.select(*edge_columns(F.col("child"), F.col("parent"), "MutatedFrom", 1.0, prov, F.array("parent", "child")))


def _walk(edges: DataFrame, node: str, upward: bool, depth: int | None) -> DataFrame:
    own = edges.where("relation = 'MutatedFrom'")
    a, b = ("source", "target") if upward else ("target", "source")
    first = own.groupBy(a).agg(F.min(b).alias(b)) if upward else own.select(a, b)  # one parent each: the smallest
    steps = first.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(1.0).alias("c"))
    root = edges.sparkSession.createDataFrame([(node,)], "node string")
    return breadth_first(steps, root, depth).where("hop > 0").select("node", "hop")


def ancestors(edges: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    """(node, hop), the oldest with the largest hop; all of them without a depth, each once on a cycle."""
    return _walk(edges, node, True, depth)


def descendants(edges: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    return _walk(edges, node, False, depth)


def lineage_chain(edges: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    """(node, position): ancestors before 0, the node at 0, descendants after; nothing for an unknown node."""
    up = ancestors(edges, node, depth).select("node", (-F.col("hop")).alias("position"))
    down = descendants(edges, node, depth).select("node", F.col("hop").alias("position"))
    known = edges.where(((F.col("source") == node) | (F.col("target") == node)) & (F.col("relation") == "MutatedFrom")).limit(1)
    own = known.select(F.lit(node).alias("node"), F.lit(0).alias("position"))
    return up.unionByName(own).unionByName(down)
