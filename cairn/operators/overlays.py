"""Overlays: views that contribute nodes and edges."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.confidence import depth_confidence
from cairn.functions.identity import address_of, process_address, statement_address
from cairn.plans.fixpoint import breadth_first
from cairn.schema import NODES, edge_columns, node_columns, provenance

from .resolve import trace_edges


class Overlay(Protocol):
    """What an overlay offers; ground_truth is its level of certainty."""

    name: str
    ground_truth: str

    def nodes(self) -> DataFrame: ...

    def edges(self) -> DataFrame: ...


def sequential(rows: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Each row but the last of its key with the next row's order."""
    return rows.withColumn(out, F.lead(order).over(Window.partitionBy(*keys).orderBy(order))).where(F.col(out).isNotNull())


def branch_targets(control_flow: DataFrame) -> DataFrame:
    """Edges of sources with several targets."""
    many = control_flow.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source")
    return control_flow.join(many, "source", "left_semi")


def dependence_edges(flow: DataFrame) -> DataFrame:
    """Program dependence: data flow as it is, and control dependence of branch targets."""
    control = branch_targets(flow.where("relation = 'ControlFlow'"))
    own = control.select(*edge_columns(F.col("source"), F.col("target"), "ControlDependence", F.col("confidence"), provenance(actor="pdg")))
    return flow.where("relation = 'DataFlow'").select("source", "target", "relation", "confidence", "provenance", "evidence").unionByName(own)


def flow_overlay(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statement nodes and edges of flow rows (path, relation, from/to start and end bytes)."""
    ends = lambda a, b: statement_address("path", a, b)
    prov = provenance(actor="flow")
    nodes = None
    for a, b in (("from_start", "from_end"), ("to_start", "to_end")):
        span = F.struct(F.col(a).alias("start_byte"), F.col(b).alias("end_byte"), F.lit(None).cast("bigint").alias("start_line"), F.lit(None).cast("bigint").alias("end_line"))
        own = flows.select(*node_columns(ends(a, b), "Symbol", ends(a, b), span, prov))
        nodes = own if nodes is None else nodes.unionByName(own)
    edge = lambda rel: flows.where(F.col("relation") == rel).select(*edge_columns(ends("from_start", "from_end"), ends("to_start", "to_end"), rel, 1.0, prov))
    return nodes.dropDuplicates(["address"]), edge("ControlFlow").unionByName(edge("DataFlow"))


def process_overlay(entrypoints: DataFrame, edges: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Process nodes of (name, address) entry points, and PartOfProcess edges from what they call, fading by depth."""
    prov = provenance(actor="process")
    nodes = entrypoints.select(*node_columns(process_address("name"), "Process", address_of("name"), None, prov)).dropDuplicates(["address"])
    calls = edges.where("relation = 'Calls'").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("c"))
    reached = breadth_first(calls, entrypoints.select(F.col("address").alias("node")), max_depth)
    own = reached.join(entrypoints.select(F.col("address").alias("root"), "name"), "root")
    return nodes, own.select(*edge_columns(F.col("node"), process_address("name"), "PartOfProcess", depth_confidence("hop"), prov))


def call_graph(edges: DataFrame) -> DataFrame:
    """(source, target) of who calls whom, once each."""
    return edges.where("relation = 'Calls'").select("source", "target").distinct()


def runtime_overlay(trace: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls seen at run time; they add no nodes."""
    edges = trace_edges(trace, symbols)
    return symbols.sparkSession.createDataFrame([], NODES), edges


def scip_overlay(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the symbols and of the places that refer to them, and the References between them."""
    edges = scip_edges(occurrences)
    prov = provenance(actor="scip")
    ends = edges.select(F.col("source").alias("a")).unionByName(edges.select(F.col("target").alias("a"))).distinct()
    return ends.select(*node_columns(F.col("a"), "Symbol", F.col("a"), None, prov)), edges


def scip_edges(occurrences: DataFrame) -> DataFrame:
    """References within documents from (relative_path, symbol, role, line) rows, each to its definition there."""
    d = occurrences.where("role = 'definition'").select("relative_path", "symbol").distinct()
    r = occurrences.where("role <> 'definition'").join(d, ["relative_path", "symbol"])
    source = address_of(F.concat_ws(":", F.lit("scip-ref"), "relative_path", "line"))
    return r.select(*edge_columns(source, address_of(F.concat_ws(":", F.lit("scip"), "symbol")), "References", 1.0, provenance(actor="scip")))
