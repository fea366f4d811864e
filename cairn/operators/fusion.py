"""Fusing overlays: independent evidence for one edge becomes one edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.confidence import noisy_or
from cairn.schema import provenance


def union_overlays(overlays: list[DataFrame]) -> DataFrame:
    """UNION ALL with the overlays' order as overlay_ord."""
    return reduce(DataFrame.unionByName, [o.withColumn("overlay_ord", F.lit(i)) for i, o in enumerate(overlays)])


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One row per address: that of the first overlay (overlay_ord, then creation and kind).

    Equal rows go by hashing before the choice, which sorts; rows with maps can't be compared and all go there.
    """
    rest = [c for c in nodes.columns if c not in ("address", "overlay_ord")]
    order = [c for c in ("overlay_ord", "created_at", "kind") if c in nodes.columns]
    rows = nodes if any("map<" in kind for _, kind in nodes.dtypes) else nodes.distinct()
    picked = rows.groupBy("address").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select("address", *[F.col(f"row.{c}").alias(c) for c in rest])


def fuse_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, relation), in one shuffle of the edges as they are.

    All evidence is kept, so partial groups would be no smaller than their edges, and each would carry its buffers.

    A single edge keeps its provenance; several get their noisy-or, consolidated provenance and all their evidence, in
    the order of overlay_ord and edge_ord where these columns exist.
    """
    order = [c for c in ("overlay_ord", "edge_ord") if c in edges.columns]
    first = F.min_by(F.struct("confidence", "provenance"), F.struct(*order)) if order else F.min(F.struct("confidence", "provenance"))
    listed = F.sort_array(F.collect_list(F.struct(*order, "evidence")))
    keys = ["source", "target", "relation"]
    grouped = edges.repartition(*keys).groupBy(*keys).agg(noisy_or("confidence").alias("fused"), F.count("*").alias("n"), first.alias("own"), F.flatten(F.transform(listed, lambda s: s["evidence"])).alias("evidence"))
    single = F.col("n") == 1
    return grouped.select(
        "source",
        "target",
        "relation",
        F.when(single, F.col("own.confidence")).otherwise(F.col("fused")).alias("confidence"),
        F.when(single, F.col("own.provenance")).otherwise(provenance("Consolidated", "fusion", 0)).alias("provenance"),
        "evidence",
    )


def fuse_confidence(edges: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, n): fusion without provenance and evidence, for graph loops."""
    return edges.groupBy("source", "target", "relation").agg(
        F.when(F.count("*") == 1, F.min("confidence")).otherwise(noisy_or("confidence")).alias("confidence"), F.count("*").alias("n")
    )
