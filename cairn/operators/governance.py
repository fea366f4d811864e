"""Policies over operations, and the gate before writes."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Actions of policy files and their decisions.
DECISIONS = {"allow": "Allow", "deny": "Deny", "require-approval": "RequireApproval", "require_approval": "RequireApproval"}
_CONDITION = re.compile(r"\s*(impact_nodes|changed_files)\s*(>=|==|>|<)\s*(-?\d{1,18})\s*\Z")
LEAST_CONFIDENCE = 0.5


@dataclass(frozen=True)
class Rule:
    operation: str
    condition: str
    action: str


def load_rules(path: str) -> list[Rule]:
    """Rules in file order; a missing file has none."""
    try:
        with open(path, "rb") as f:
            return [Rule(r["operation"], r.get("condition", "always"), r["action"]) for r in tomllib.load(f).get("rules", [])]
    except FileNotFoundError:
        return []


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules with the condition taken apart; conditions that can't be read never hold."""
    rows = []
    for i, r in enumerate(rules):
        m = _CONDITION.match(r.condition)
        rows.append((i, r.operation, r.condition.strip() == "always", m[1] if m else None, m[2] if m else None, int(m[3]) if m else None, DECISIONS.get(r.action.lower(), "Allow")))
    return spark.createDataFrame(rows, "ord int, operation string, always boolean, field string, op string, bound bigint, decision string")


def decide(contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Contexts (operation, impact_nodes, changed_files, ...) with the decision of the first rule that holds, else Allow."""
    names = contexts.columns
    value = F.when(F.col("field") == "impact_nodes", F.col("impact_nodes")).when(F.col("field") == "changed_files", F.col("changed_files"))
    tests = {">": value > F.col("bound"), ">=": value >= F.col("bound"), "<": value < F.col("bound"), "==": value == F.col("bound")}
    holds = F.col("always")
    for op, test in tests.items():
        holds = holds | ((F.col("op") == op) & test)
    met = contexts.join(F.broadcast(rules), "operation", "left")  # a policy file's few rows
    met = met.withColumn("__holds", F.coalesce(holds, F.lit(False)))
    best = met.groupBy(*names).agg(F.min_by(F.when(F.col("__holds"), F.col("decision")), F.when(F.col("__holds"), F.col("ord"))).alias("decision"))
    return best.select(*names, F.coalesce("decision", F.lit("Allow")).alias("decision"))


def write_gate(actor: Column, is_fresh: Column, min_edge_confidence: Column, require_freshness: bool = True) -> Column:
    """struct<decision, reason> of a write request, checked in order."""
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(F.trim(actor), F.lit("")) == "", out("Deny", "actor is empty"))
        .when(F.lit(require_freshness) & ~F.coalesce(is_fresh, F.lit(False)), out("Deny", "index is stale"))
        .when(F.coalesce(min_edge_confidence, F.lit(0.0)) < LEAST_CONFIDENCE, out("Deny", "confidence is low"))
        .otherwise(out("Allow", ""))
    )


def check_write(actor: str, is_fresh: bool, min_edge_confidence: float, require_freshness: bool = True) -> None:
    """Raise PermissionError unless a write is allowed."""
    if not actor.strip():
        raise PermissionError("actor is empty")
    if require_freshness and not is_fresh:
        raise PermissionError("index is stale")
    if min_edge_confidence < LEAST_CONFIDENCE:
        raise PermissionError("confidence is low")
