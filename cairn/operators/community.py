"""Communities: undirected components over chosen relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.checkpoint import cut
from cairn.plans.components import connected_components

from .graph import Graph


def component_labels(graph: Graph, relations: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """(node, root) for nodes in components of more than one node."""
    e = graph.filtered_edges(relations, min_confidence)
    return connected_components(e.select(F.col("source").alias("a"), F.col("target").alias("b")))


def find_components(graph: Graph, relations: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """(component_id, size, edge_count, avg_confidence) with edges inside each component; members stay in the labels."""
    labels = cut(component_labels(graph, relations, min_confidence))
    e = graph.filtered_edges(relations, min_confidence)
    inside = e.join(labels.withColumnRenamed("node", "source"), "source").groupBy("root").agg(F.count("*").alias("edge_count"), F.avg("confidence").alias("avg_confidence"))
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    return sizes.join(inside, "root", "left").select(F.col("root").alias("component_id"), "size", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))


def module_clusters(graph: Graph, min_confidence: float = 0.0) -> DataFrame:
    return find_components(graph, ("Calls", "Imports"), min_confidence)
