"""Graphs of single files: names resolve within their own file only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import file_address
from cairn.operators.graph import Graph
from cairn.schema import edge_columns, provenance

from . import pipeline


def innermost_symbols(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """`spans` (path, start_byte, end_byte) with enclosing: the narrowest symbol of the file around each."""
    s = symbols.select("path", F.col("start_byte").alias("s_start"), F.col("end_byte").alias("s_end"), F.col("address").alias("s_address"))
    wanted = spans.select("path", "start_byte", "end_byte").distinct()
    held = wanted.join(s, "path").where("s_start <= start_byte and end_byte <= s_end")
    best = held.groupBy("path", "start_byte", "end_byte").agg(F.min_by("s_address", F.struct(F.col("s_end") - F.col("s_start"), F.col("s_start"))).alias("enclosing"))
    return spans.join(best, ["path", "start_byte", "end_byte"])


def file_graphs(files: DataFrame, ir: DataFrame) -> Graph:
    """File and symbol nodes of every file; Contains, and the Imports, Calls and Implements edges inside each file."""
    own = pipeline.symbols(ir)
    nodes, contains = pipeline.syntax(files, ir)
    table = own.groupBy("path", "name").agg(F.max_by("address", "ordinal").alias("resolved"))
    named = lambda column: table.select("path", F.col("name").alias(column), F.col("resolved").alias(f"{column}_address"))
    prov = provenance(actor="parser")
    imports = ir.where("kind = 'import'").select("path", "name").join(named("name"), ["path", "name"])
    calls = ir.where("kind = 'call'").select("path", "name", F.col("other_start").alias("start_byte"), F.col("other_end").alias("end_byte"))
    calls = innermost_symbols(calls.join(named("name"), ["path", "name"]), own)
    impls = ir.where("kind = 'impl' and extra is not null").select("path", "name", "extra").join(named("name"), ["path", "name"]).join(named("extra"), ["path", "extra"])
    edges = contains.unionByName(imports.select(*edge_columns(file_address("path"), F.col("name_address"), "Imports", 0.8, prov)))
    edges = edges.unionByName(calls.select(*edge_columns(F.col("enclosing"), F.col("name_address"), "Calls", 0.7, prov)))
    return Graph(nodes, edges.unionByName(impls.select(*edge_columns(F.col("name_address"), F.col("extra_address"), "Implements", 0.8, prov))))
