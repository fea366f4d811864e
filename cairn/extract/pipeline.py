"""Extraction over a table of files, and the overlays that follow from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import file_address, symbol_address
from cairn.operators import fusion, overlays, resolve
from cairn.operators.graph import Graph
from cairn.plans.checkpoint import cut, cut_unsized
from cairn.schema import edge_columns, node_columns, provenance
from cairn.sources.store import FileCache

from . import braces, python
from .rows import IR, IR_NAMES, Rows

#: Extractors by language; callers may add their own.
REGISTRY: dict[str, Callable[[str, bytes], Rows]] = {"python": python.extract, "rust": braces.rust, "typescript": braces.typescript, "typescript-tsx": braces.typescript_tsx}


def extract(files: DataFrame) -> DataFrame:
    """All rows of (path, content, lang) files, every file read once; unknown languages give none."""
    registry = dict(REGISTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, lang in zip(*(b.column(c).to_pylist() for c in ("path", "content", "lang"))):
                if lang in registry and content is not None:
                    rows += registry[lang](path, bytes(content)).out
            columns = list(zip(*rows)) if rows else [[] for _ in IR_NAMES]
            texts = {"path", "lang", "kind", "name", "extra", "syntax_kind", "content_hash"}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in texts else pa.int64()) for n, c in zip(IR_NAMES, columns)], names=IR_NAMES)

    return files.select("path", "content", "lang").mapInArrow(run, IR)


def extract_cached(files: DataFrame, cache: FileCache) -> DataFrame:
    """As `extract`, but only files whose content the cache doesn't hold are read; what they give is added to it.

    Every file has a row of kind file in the cache, so that one without any other row is known too.
    """
    keyed = files.withColumn("file_hash", F.sha2("content", 256))
    hashes = cut(keyed.select("path", "file_hash"))
    fresh = cache.missing(keyed, IR)
    seen = fresh.select("path", "lang", F.lit("file").alias("kind"), "file_hash")
    found = extract(fresh).join(hashes, "path").unionByName(seen, allowMissingColumns=True)
    cache.put(found.select(*IR_NAMES, "file_hash"))
    return cache.get(hashes, IR).where("kind <> 'file'").select(*IR_NAMES)


def failures(ir: DataFrame) -> DataFrame:
    """(path, reason) of files that couldn't be read."""
    return ir.where("kind = 'failed'").select("path", F.col("name").alias("reason"))


def symbols(ir: DataFrame) -> DataFrame:
    """Symbol rows with their address."""
    return ir.where("kind = 'symbol'").withColumn("address", symbol_address("path", "syntax_kind", "name"))


def _span(*names: str):
    return F.struct(*[F.col(n).alias(a) for n, a in zip(names, ("start_byte", "end_byte", "start_line", "end_line"))])


def syntax(files: DataFrame, ir: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and symbol nodes, and Contains edges."""
    prov = provenance(actor="parser")
    own = symbols(ir)
    f = files.select(*node_columns(file_address("path"), "File", F.sha2("content", 256), None, prov))
    s = own.select(*node_columns(F.col("address"), "Symbol", F.col("content_hash"), _span("start_byte", "end_byte", "start_line", "end_line"), prov))
    return f.unionByName(s), own.select(*edge_columns(file_address("path"), F.col("address"), "Contains", 1.0, prov))


def semantic(ir: DataFrame) -> DataFrame:
    """Imports, Calls and Implements edges of names that resolve."""
    own = symbols(ir)
    kind = lambda k: ir.where(F.col("kind") == k)
    imports = resolve.import_edges(kind("import").select("path", "name"), own)
    calls = resolve.call_edges(kind("call").select("path", "name", F.col("other_start").alias("caller_start"), F.col("other_end").alias("caller_end")), own)
    impls = resolve.implement_edges(kind("impl").select("path", F.col("name").alias("type_name"), F.col("extra").alias("trait_name")), own)
    return imports.unionByName(calls).unionByName(impls)


def flow(ir: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statement nodes, ControlFlow and DataFlow edges; data flow is the def-use join."""
    control = ir.where("kind = 'control'").select("path", F.lit("ControlFlow").alias("relation"), F.col("start_byte").alias("from_start"), F.col("end_byte").alias("from_end"), F.col("other_start").alias("to_start"), F.col("other_end").alias("to_end"))
    uses = resolve.def_use(ir.where("kind = 'def'"), ir.where("kind = 'use'"))
    data = uses.select("path", F.lit("DataFlow").alias("relation"), F.col("def_start").alias("from_start"), F.col("def_end").alias("from_end"), F.col("use_start").alias("to_start"), F.col("use_end").alias("to_end"))
    return overlays.flow_overlay(control.unionByName(data))


def entrypoints(ir: DataFrame) -> DataFrame:
    """(name, address) of functions where processes start, if the syntax overlay has them."""
    e = ir.where("kind = 'entry'").select("name", symbol_address("path", F.lit("function_item"), "name").alias("address"))
    return e.join(symbols(ir).select("address").hint("merge"), "address", "left_semi").select("name", "address")


#: Overlays that follow from what readers found.
DERIVED = ("process", "pdg")


def derived_overlays(ir: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Nodes and edges of the overlays that follow from others: processes, and program dependence."""
    flow_nodes, flows = flow(ir)
    return {"process": overlays.process_overlay(entrypoints(ir), semantic(ir)), "pdg": (flow_nodes, overlays.dependence_edges(flows))}


def index(files: DataFrame, cache: FileCache | None = None) -> Graph:
    """The fused graph of a table of files: one extraction pass, joins, and one shuffle to fuse."""
    return fused(files, cut_unsized(extract_cached(files, cache) if cache else extract(files)))


def fused(files: DataFrame, ir: DataFrame) -> Graph:
    syntax_nodes, contains = syntax(files, ir)
    flow_nodes, flows = flow(ir)
    nodes = fusion.dedup_nodes(fusion.union_overlays([syntax_nodes, flow_nodes]))
    return Graph(nodes, fusion.fuse_edges(fusion.union_overlays([contains, semantic(ir), flows])))
