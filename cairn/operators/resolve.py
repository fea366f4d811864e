"""Joins that turn names, lines and files into addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.identity import file_address, normalize_path
from cairn.functions.confidence import trace_confidence
from cairn.schema import edge_columns, provenance


def symbol_table(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, address) with the last of a file winning, and (name, address) of globally unique names."""
    scoped = symbols.groupBy("path", "name").agg(F.max_by("address", "ordinal").alias("address"))
    named = symbols.groupBy("name").agg(F.min("address").alias("address"), F.max("address").alias("other"))
    return scoped, named.where("address = other").select("name", "address")


def resolve_names(references: DataFrame, symbols: DataFrame, name: str = "name") -> DataFrame:
    """`references` with resolved: the symbol in the same file, else the only one of that name anywhere, else null."""
    scoped, unique = symbol_table(symbols)
    near = scoped.select("path", F.col("name").alias(name), F.col("address").alias("__near"))
    far = unique.select(F.col("name").alias(name), F.col("address").alias("__far"))
    return references.join(near, ["path", name], "left").join(far, name, "left").withColumn("resolved", F.coalesce("__near", "__far")).drop("__near", "__far")


def enclosing(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """`references` (path, start_byte, end_byte) with the symbol of exactly that span; the last of equals wins."""
    own = symbols.groupBy("path", "start_byte", "end_byte").agg(F.max_by("address", "ordinal").alias("enclosing"))
    return references.join(own, ["path", "start_byte", "end_byte"])


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    got = resolve_names(imports, symbols).where("resolved is not null")
    return got.select(*edge_columns(file_address("path"), F.col("resolved"), "Imports", 0.8, provenance(actor="resolver")))


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (path, caller_start, caller_end, name); caller and callee must both resolve."""
    got = resolve_names(calls, symbols).where("resolved is not null")
    got = enclosing(got.withColumnsRenamed({"caller_start": "start_byte", "caller_end": "end_byte"}), symbols)
    return got.select(*edge_columns(F.col("enclosing"), F.col("resolved"), "Calls", 0.7, provenance(actor="resolver")))


def implement_edges(impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Impls (path, type_name, trait_name) with a trait; both ends must resolve."""
    got = resolve_names(impls.where("trait_name is not null"), symbols, "type_name").withColumnRenamed("resolved", "own")
    got = resolve_names(got, symbols, "trait_name").where("own is not null and resolved is not null")
    return got.select(*edge_columns(F.col("own"), F.col("resolved"), "Implements", 0.8, provenance(actor="resolver")))


#: Lines of a block; spans and lines meet in the blocks they cover, not in the whole file.
BLOCK_LINES = 256


def blocks(start: Column | str, end: Column | str) -> Column:
    """Numbers of the blocks that a range of lines covers, one row each."""
    number = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / BLOCK_LINES)
    return F.explode(F.sequence(number(start), F.greatest(number(start), number(end))))


def innermost_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, address, ties): the narrowest span of the same file around each line; ties counts equal widths."""
    inside = spans.withColumn("block", blocks("start_line", "end_line"))
    held = points.withColumn("block", F.floor(F.col("line") / BLOCK_LINES)).join(inside, ["path", "block"]).where("line between start_line and end_line")
    widths = held.groupBy("path", "line", (F.col("end_line") - F.col("start_line")).alias("width")).agg(F.min("address").alias("address"), F.count("*").alias("ties"))
    best = widths.groupBy("path", "line").agg(F.min(F.struct("width", "address", "ties")).alias("best"))
    return best.select("path", "line", "best.address", "best.ties")


def find_at(path: str, line: int, spans: DataFrame) -> str:
    """The address at a location; raises where there is none or no innermost one."""
    point = spans.sparkSession.createDataFrame([(path, line)], "path string, line bigint")
    row = innermost_span(point, spans).first()
    if row is None:
        raise LookupError(f"nothing at {path}:{line}")
    if row.ties > 1:
        raise LookupError(f"{row.ties} symbols of equal size at {path}:{line}")
    return row.address


def resolve_file(files: DataFrame, wanted: str) -> str:
    """The indexed path equal to `wanted`, or the only one that ends with it after a slash."""
    spark = files.sparkSession
    asked = spark.createDataFrame([(wanted,)], "wanted string").select(normalize_path("wanted").alias("wanted"))
    near = files.select(normalize_path("path").alias("normal"), "path").join(F.broadcast(asked), F.expr("normal = wanted or endswith(normal, '/' || wanted)"))
    rows = near.orderBy((F.col("normal") != F.col("wanted")).cast("int"), "path").limit(2).collect()
    if not rows or (len(rows) > 1 and rows[0].normal != rows[0].wanted):
        raise LookupError(f"{wanted}: {'not indexed' if not rows else 'ambiguous'}")
    return rows[0].path


def sibling_classes(edges: DataFrame) -> DataFrame:
    """(parent, node, siblings): the children of every parent and how many others it has; a row a child, no pairs."""
    c = edges.where("relation = 'Contains'").select(F.col("source").alias("parent"), F.col("target").alias("node"))
    counts = c.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    return c.join(counts, "parent")


#: Children of one parent that meet in a task as one side of pairs.
SIBLING_BLOCK = 4096


def siblings(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, sibling) under a common parent, of the asked nodes (node) or of all; doubles are kept.

    Of all nodes, a parent of n children gives n * (n - 1) rows: `sibling_classes` says the same in n. Such children are
    dealt into blocks and each two blocks meet by themselves, so no task holds more than a block of either side.
    """
    c = edges.where("relation = 'Contains'")
    a = c.select(F.col("source").alias("parent"), F.col("target").alias("node"))
    a = a if nodes is None else a.join(nodes.select("node").distinct(), "node", "left_semi")
    b = c.select(F.col("source").alias("parent"), F.col("target").alias("sibling"))
    if nodes is None:
        counts = c.groupBy(F.col("source").alias("parent")).agg(F.ceil(F.count("*") / SIBLING_BLOCK).alias("blocks"))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        a = a.join(counts, "parent").select("parent", "node", F.pmod(F.xxhash64("node"), "blocks").alias("i"), each.alias("j"))
        b = b.join(counts, "parent").select("parent", "sibling", each.alias("i"), F.pmod(F.xxhash64("sibling"), "blocks").alias("j"))
    return a.join(b, [k for k in ("parent", "i", "j") if k in a.columns]).where("node <> sibling").select("node", "sibling")


def freshness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row (is_fresh, changed, added, removed) from two (path, hash) tables."""
    both = indexed.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    counts = both.agg(
        F.count_if(F.expr("old is not null and new is not null and old <> new")).alias("changed"), F.count_if(F.expr("old is null")).alias("added"), F.count_if(F.expr("new is null")).alias("removed")
    )
    return counts.select(F.expr("changed + added + removed = 0").alias("is_fresh"), "changed", "added", "removed")


def def_use(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Earliest definition (by ordinal) of the same name in the same scope that ends before the use begins.

    Definitions and uses of a name are put in one order of bytes and the least definition so far is carried along it,
    so a name with many of both costs a sort and not their product.
    """
    keys = ["path", "scope", "name"]
    none = F.lit(None)
    d = definitions.select(*keys, F.col("end_byte").alias("at"), F.lit(1).alias("side"), F.struct("ordinal", F.col("start_byte").alias("def_start"), F.col("end_byte").alias("def_end")).alias("d"), none.cast("bigint").alias("use_end"))
    u = uses.select(*keys, F.col("start_byte").alias("at"), F.lit(0).alias("side"), none.cast(d.schema["d"].dataType).alias("d"), F.col("end_byte").alias("use_end")).distinct()
    so_far = F.min("d").over(Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    met = d.unionByName(u).withColumn("d", so_far).where("side = 0 and d is not null")
    return met.select(*keys, F.col("at").alias("use_start"), "use_end", "d.def_start", "d.def_end")


def trace_edges(trace: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls seen at run time (caller, callee, count); names resolve to the last symbol of that name."""
    named = symbols.groupBy("name").agg(F.max_by("address", F.struct("path", "ordinal")).alias("address"))
    got = trace.withColumn("n", F.expr("try_cast(count as double)")).where("n is not null")
    got = got.join(named.select(F.col("name").alias("caller"), F.col("address").alias("s")), "caller").join(named.select(F.col("name").alias("callee"), F.col("address").alias("t")), "callee")
    return got.select(*edge_columns(F.col("s"), F.col("t"), "Calls", trace_confidence("n"), provenance(actor="runtime")))


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
