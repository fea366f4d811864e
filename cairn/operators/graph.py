"""A property graph over two DataFrames, and its queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import Direction
from cairn.plans.checkpoint import cut_counted
from cairn.plans.fixpoint import best_products, breadth_first, every_round, frontier, longest_levels, with_paths


@dataclass(frozen=True)
class Query:
    """A declarative traversal."""

    target: str
    direction: Direction = Direction.DOWNSTREAM
    max_depth: int = 1
    min_confidence: float = 0.0
    relations: tuple[str, ...] | None = None


@dataclass(frozen=True)
class QueryResult:
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame


class Graph:
    """`nodes` and `edges` as in cairn.schema; extra columns are carried.  `held` tells that the caller keeps the edges laid by source."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, held: bool = False):
        self.nodes, self.edges, self.held = nodes, edges, held

    def union(self, other: Graph) -> Graph:
        """Both graphs' rows, without removing doubles."""
        return Graph(self.nodes.unionByName(other.nodes, allowMissingColumns=True), self.edges.unionByName(other.edges, allowMissingColumns=True))

    def filtered_edges(self, relations: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
        e = self.edges.where(F.col("confidence") >= min_confidence)
        return e.where(F.col("relation").isin(list(relations))) if relations is not None else e

    def oriented(self, direction: Direction, relations: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
        """(src, dst, c) along the direction; Both is the two orientations together."""
        e = self.filtered_edges(relations, min_confidence)
        down = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("confidence").alias("c"))
        up = e.select(F.col("target").alias("src"), F.col("source").alias("dst"), F.col("confidence").alias("c"))
        return {Direction.DOWNSTREAM: down, Direction.UPSTREAM: up}.get(direction, down.unionByName(up))

    def neighbors(self, address: str, direction: Direction = Direction.DOWNSTREAM, relations: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
        """(neighbor, relation, confidence), one row per edge."""
        e = self.filtered_edges(relations, min_confidence)
        down = e.where(F.col("source") == address).select(F.col("target").alias("neighbor"), "relation", "confidence")
        up = e.where(F.col("target") == address).select(F.col("source").alias("neighbor"), "relation", "confidence")
        return {Direction.DOWNSTREAM: down, Direction.UPSTREAM: up}.get(direction, down.unionByName(up))

    def edges_touching(self, addresses: DataFrame) -> DataFrame:
        """Edges with an end among the addresses: two semi-joins, the second over what the first left."""
        a = addresses.select(F.col("address")).distinct()
        out = self.edges.join(a.withColumnRenamed("address", "source"), "source", "left_semi")
        rest = self.edges.join(a.withColumnRenamed("address", "source"), "source", "left_anti")
        return out.unionByName(rest.join(a.withColumnRenamed("address", "target"), "target", "left_semi").select(out.columns)).select(self.edges.columns)

    def induced(self, addresses: DataFrame) -> DataFrame:
        """Edges with both ends among the addresses."""
        a = addresses.select("address").distinct()
        e = self.edges.join(a.withColumnRenamed("address", "source"), "source", "left_semi")
        return e.join(a.withColumnRenamed("address", "target"), "target", "left_semi").select(self.edges.columns)

    def node(self, address: str) -> DataFrame:
        return self.nodes.where(F.col("address") == address)

    def nodes_in(self, addresses: DataFrame) -> DataFrame:
        return self.nodes.join(addresses.select("address").distinct(), "address", "left_semi")

    def roots(self, *addresses: str) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(a,) for a in addresses], "node string")

    def reach(self, query: Query) -> DataFrame:
        """(root, node, hop, confidence, parent).  No confidence is over 1, so weak edges can go beforehand."""
        edges = self.oriented(query.direction, query.relations, query.min_confidence)
        return breadth_first(edges, self.roots(query.target), query.max_depth, query.min_confidence)

    def execute(self, query: Query) -> QueryResult:
        """Nodes that are reached, the edges among them (of any relation), and a path to each node but the root."""
        reached = self.reach(query)
        found = reached.select(F.col("node").alias("address"))
        return QueryResult(self.nodes_in(found), self.induced(found), with_paths(reached).where("hop > 0").select("path"))

    def impact(self, seeds: DataFrame, direction: Direction = Direction.DOWNSTREAM) -> DataFrame:
        """(node, score): seeds at 1, others by the best product of confidences; Both takes the larger side."""
        start = seeds.select(F.lit("").alias("root"), F.col("node"), F.lit(1.0).alias("score"))
        sides = [Direction.DOWNSTREAM, Direction.UPSTREAM] if direction is Direction.BOTH else [direction]
        out = [best_products(self.oriented(d), start, held_edges=self.held and d is Direction.DOWNSTREAM).select("node", "score") for d in sides]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1]).groupBy("node").agg(F.max("score").alias("score"))

    def staleness(self, stale: DataFrame) -> DataFrame:
        """What depends on stale nodes: impact upstream."""
        return self.impact(stale, Direction.UPSTREAM)

    def attenuated(self, roots: DataFrame, attenuation: float, threshold: float) -> DataFrame:
        """(root, node, score) of many roots in one loop; each step is attenuated and cut at the threshold."""
        start = roots.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("score"))
        return best_products(self.oriented(Direction.DOWNSTREAM), start, attenuation, threshold)

    def topological(self, roots: DataFrame, direction: Direction = Direction.DOWNSTREAM) -> DataFrame:
        """(node, level) of what the roots reach; roots without any edge are left out."""
        start, rows = cut_counted(roots.select("node").distinct())
        with every_round(self.oriented(direction).select("src", "dst"), "src") as edges:
            ends = [edges.select(F.col(end).alias("node")).join(frontier(start, rows), "node", "left_semi") for end in ("src", "dst")]
            return longest_levels(edges, ends[0].unionByName(ends[1]).distinct(), held_edges=True)


def top_scores(scores: DataFrame, n: int, least: float = 0.01) -> DataFrame:
    """Scores over the least, largest first, ties by node."""
    return scores.where(F.col("score") > least).orderBy(F.col("score").desc(), "node").limit(n)
