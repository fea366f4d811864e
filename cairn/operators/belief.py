"""Beliefs: claims about nodes with evidence for and against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import address_of, belief_address
from cairn.schema import edge_columns, node_columns, provenance


def create_beliefs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (claim, subject, confidence, actor, timestamp, supports[], contradicts[])."""
    prov = provenance("HumanAssertion", F.col("actor"), F.col("timestamp"), F.try_element_at("supports", F.lit(1)))
    nodes = specs.select(*node_columns(belief_address("claim"), "Belief", address_of("claim"), None, prov, F.col("confidence")))
    own = lambda df, target, relation: df.select(*edge_columns(belief_address("claim"), target, relation, F.col("confidence"), prov))
    edges = own(specs, F.col("subject"), "AboutSubject")
    for column, relation in (("supports", "Supports"), ("contradicts", "Contradicts")):
        edges = edges.unionByName(own(specs.withColumn("__t", F.explode(column)), F.col("__t"), relation))
    return nodes, edges


def beliefs_about(nodes: DataFrame, edges: DataFrame, subject: str) -> DataFrame:
    """(address, confidence, edges[]) of each belief about the subject, with all edges that leave it."""
    about = edges.where((F.col("relation") == "AboutSubject") & (F.col("target") == subject)).select(F.col("source").alias("address")).distinct()
    held = nodes.where("kind = 'Belief'").join(about, "address", "left_semi").select("address", "confidence")
    out = edges.select(F.col("source").alias("address"), F.struct("relation", "target").alias("edge"))
    return held.join(out, "address").groupBy("address", "confidence").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def beliefs_by_actor(nodes: DataFrame, actor: str) -> DataFrame:
    return nodes.where((F.col("kind") == "Belief") & (F.col("provenance.actor") == actor))


def evidence_for(edges: DataFrame, belief: str, relation: str = "Supports") -> DataFrame:
    return edges.where((F.col("source") == belief) & (F.col("relation") == relation)).select("target")
