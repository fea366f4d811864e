"""Schemas and vocabularies of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# The names that stored graphs use.
NODE_KINDS = ("File", "Symbol", "Process", "Scope", "Belief")
RELATIONS = (
    "Contains", "Calls", "Imports", "Implements", "Extends", "References", "ControlFlow", "DataFlow", "ControlDependence", "PartOfProcess",
    "CoupledWithin", "Dominates", "MutatedFrom", "AboutSubject", "Supports", "Contradicts",
)
SOURCES = ("ToolOutput", "HumanAssertion", "Inference", "Consolidated")
OVERLAYS = ("syntax", "semantic", "flow", "runtime", "process")

PROVENANCE = StructType([StructField("source", StringType()), StructField("actor", StringType()), StructField("timestamp", LongType()), StructField("justification", StringType())])
SPAN = StructType([StructField(n, LongType()) for n in ("start_byte", "end_byte", "start_line", "end_line")])
NODES = StructType(
    [
        StructField("address", StringType()),
        StructField("kind", StringType()),
        StructField("provenance", PROVENANCE),
        StructField("confidence", DoubleType()),
        StructField("created_at", LongType()),
        StructField("content_hash", StringType()),
        StructField("span", SPAN),
    ]
)
EDGES = StructType(
    [
        StructField("source", StringType()),
        StructField("target", StringType()),
        StructField("relation", StringType()),
        StructField("confidence", DoubleType()),
        StructField("provenance", PROVENANCE),
        StructField("evidence", ArrayType(StringType())),
    ]
)


def provenance(source: str = "ToolOutput", actor: str | Column = "test", timestamp: int | Column = 0, justification: str | Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(source).alias("source"), as_column(actor).alias("actor"), as_column(timestamp).cast("bigint").alias("timestamp"), as_column(justification).cast("string").alias("justification")
    )


def edge_columns(source: Column, target: Column, relation: str, confidence: float | Column = 1.0, prov: Column | None = None, evidence: Column | None = None) -> list[Column]:
    """Projection of a row to an edge."""
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return [
        source.alias("source"),
        target.alias("target"),
        F.lit(relation).alias("relation"),
        c.alias("confidence"),
        (prov if prov is not None else provenance()).alias("provenance"),
        (evidence if evidence is not None else F.array().cast("array<string>")).alias("evidence"),
    ]


def node_columns(address: Column, kind: str, content_hash: Column, span: Column | None = None, prov: Column | None = None, confidence: float | Column = 1.0) -> list[Column]:
    """Projection of a row to a node."""
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    p = prov if prov is not None else provenance()
    return [
        address.alias("address"),
        F.lit(kind).alias("kind"),
        p.alias("provenance"),
        c.alias("confidence"),
        p["timestamp"].alias("created_at"),
        content_hash.alias("content_hash"),
        (span if span is not None else F.lit(None)).cast(SPAN).alias("span"),
    ]
