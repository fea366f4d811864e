"""Graphs for display."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import node_label

#: Rows of a document, which the driver holds.
SHOWN = 200_000
TEMPLATE = "<!DOCTYPE html><meta charset='utf-8'><title>graph</title><pre id='out'></pre><script>const graph = {{GRAPH_DATA}};document.getElementById('out').textContent = JSON.stringify(graph, null, 1);</script>"


def cytoscape_rows(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.0, relations: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON text of each node and each edge; only edges are filtered."""
    e = edges.where(F.col("confidence") >= min_confidence)
    e = e.where(F.col("relation").isin(list(relations))) if relations is not None else e
    n = nodes.select(F.to_json(F.struct(F.struct(F.col("address").alias("id"), "kind", "confidence", node_label("kind", "span").alias("label")).alias("data"))).alias("json"))
    return n, e.select(F.to_json(F.struct(F.struct("source", "target", "relation", "confidence").alias("data"))).alias("json"))


def cytoscape_json(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.0, relations: tuple[str, ...] | None = None) -> str:
    """One document, for graphs that a browser can show; a larger one than SHOWN rows is refused."""
    shown = cytoscape_rows(nodes, edges, min_confidence, relations)
    if sum(df.limit(SHOWN + 1).count() for df in shown) > SHOWN:
        raise ValueError(f"more than {SHOWN} nodes and edges; choose relations, a least confidence or a neighbourhood")
    parts = [[json.loads(r.json) for r in df.collect()] for df in shown]
    return json.dumps({"nodes": parts[0], "edges": parts[1]})


def html_page(graph_json: str, template: str = TEMPLATE) -> str:
    return template.replace("{{GRAPH_DATA}}", graph_json.replace("</", "<\\/"))
