"""From a diff to what it touches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import Direction
from cairn.plans.checkpoint import cut
from cairn.plans.fixpoint import kept, laid

from .graph import Graph
from .resolve import blocks


@dataclass(frozen=True)
class ChangeSet:
    changed: DataFrame
    affected_edges: DataFrame
    impact: DataFrame
    staleness: DataFrame


def changed_nodes(nodes: DataFrame, hunks: DataFrame, contained: DataFrame | None = None) -> DataFrame:
    """Addresses of nodes whose lines a hunk (path, new_start, new_lines) covers.

    Nodes and hunks meet in the blocks of lines that they cover.
    With `contained` (address, path) a hunk only touches nodes of its own file; without it, nodes of every file.
    """
    lined = nodes.where("span is not null").select("address", F.col("span.start_line").alias("a"), F.col("span.end_line").alias("z"))
    over = F.expr("a < new_start + new_lines and z >= new_start")
    keys = ["block"]
    if contained is not None:
        lined, keys = lined.join(contained.select("address", "path"), "address"), ["path", "block"]
    lined = lined.withColumn("block", blocks("a", "z"))
    h = hunks.withColumn("block", blocks("new_start", F.col("new_start") + F.col("new_lines"))).select(*keys, "new_start", "new_lines").distinct()
    h = h.toDF(*[f"h_{k}" for k in keys], "new_start", "new_lines")
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"h_{k}") for k in keys])
    return lined.join(h, same & over, "left_semi").select("address").distinct()


def affected_edges(graph: Graph, changed: DataFrame) -> DataFrame:
    """Edges with a changed end."""
    return graph.edges_touching(changed)


def detect_changes(graph: Graph, hunks: DataFrame, contained: DataFrame | None = None) -> ChangeSet:
    """What changed and what that reaches; changed nodes and edges are computed once for both directions."""
    changed = cut(changed_nodes(graph.nodes, hunks, contained))
    seeds = changed.select(F.col("address").alias("node"))
    with kept(laid(graph.edges.select("source", "target", "confidence"), "source")) as edges:
        held = Graph(graph.nodes, edges, held=True)
        return ChangeSet(changed, affected_edges(graph, changed), held.impact(seeds, Direction.DOWNSTREAM), held.staleness(seeds))
