"""What a query may send through the driver or shuffle, whatever its estimates say."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.extract import local, pipeline
from cairn.operators import changes, fusion, overlays, resolve
from cairn.operators.graph import Graph
from cairn.plans import fixpoint
from cairn.plans.checkpoint import cut, cut_unsized
from cairn.schema import provenance


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sources(spark, n=40):
    """Files that Spark takes for a few bytes."""
    text = F.concat(F.lit("fn main() { a"), "id", F.lit("(); }\nfn a"), "id", F.lit("() { }\n"))
    return spark.range(n).select(F.concat(F.lit("m"), "id", F.lit(".rs")).alias("path"), text.cast("binary").alias("content"), F.lit("rust").alias("lang"))


def test_joins_of_extracted_rows_are_not_planned_as_broadcasts(spark):
    files = sources(spark)
    ir = cut_unsized(pipeline.extract(files))
    assert sorted(ir.collect()) == sorted(cut(pipeline.extract(files)).collect())
    for df in (pipeline.semantic(ir), local.file_graphs(files, ir).edges, overlays.call_graph(pipeline.semantic(ir)), pipeline.index(files).edges, pipeline.entrypoints(pipeline.extract(files))):
        assert "Join" in plan(df) and "BroadcastHashJoin" not in plan(df)
    assert pipeline.semantic(ir).where("relation = 'Calls'").count() == 40


def test_rounds_do_not_shuffle_edges_again(spark, monkeypatch):
    """A frontier too large to be broadcast is dealt to where the edges are; they stay."""
    monkeypatch.setattr(fixpoint, "BROADCAST_ROWS", 0)
    edges = spark.range(300).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.lit(0.5).alias("c"))
    with fixpoint.every_round(edges.select(F.col("src").alias("node"), "dst", "c"), "node") as steps:
        front = cut(spark.range(50).select(F.col("id").cast("string").alias("node")))
        rows = front.join(steps.hint("merge"), "node")
        assert rows.count() == 50
        text = plan(rows).split("InMemoryRelation")[0]
        assert text.count("Exchange hashpartitioning(node") == 1, text
    got = fixpoint.best_products(edges, spark.createDataFrame([("", "297", 1.0)], "root string, node string, score double"))
    assert {r.node: r.score for r in got.collect()} == {"297": 1.0, "298": 0.5, "299": 0.25, "300": 0.125}


def test_levels_of_roots_with_and_without_edges(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "BROADCAST_ROWS", 0)
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "a")], "source string, target string").select("source", "target", F.lit("Calls").alias("relation"), F.lit(1.0).alias("confidence"))
    g = Graph(None, e)
    levels = {r.node: r.level for r in g.topological(g.roots("a", "d", "a", "lonely")).collect()}
    assert levels == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_both_directions_of_a_change_use_edges_once(spark, monkeypatch):
    """Impact and staleness read the edges' source once, not once each."""
    seen = spark.sparkContext.accumulator(0)
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5)], "source string, target string, confidence double").withColumn("relation", F.lit("Calls"))

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = e.mapInArrow(counting, e.schema)
    span = F.struct(*[F.lit(1).cast("bigint").alias(n) for n in ("start_byte", "end_byte", "start_line", "end_line")])
    nodes = spark.createDataFrame([("b",)], "address string").withColumn("span", span)
    hunks = spark.createDataFrame([("f", 1, 1)], "path string, new_start bigint, new_lines bigint")
    got = changes.detect_changes(Graph(nodes, e), hunks)
    assert {r.node: r.score for r in got.impact.collect()} == {"b": 1.0, "c": 0.5}
    assert {r.node: r.score for r in got.staleness.collect()} == {"b": 1.0, "a": 0.5}
    assert seen.value == 2


def test_large_parents_are_divided(spark, monkeypatch):
    """No key of the join holds more than about a block of either side, and no pair or double is lost."""
    monkeypatch.setattr(resolve, "SIBLING_BLOCK", 8)
    e = spark.createDataFrame([("p", f"c{i % 60}") for i in range(64)] + [("q", "x"), ("q", "y"), ("r", "z"), (None, "u"), ("p", None)], "source string, target string").withColumn("relation", F.lit("Contains"))
    c = [f"c{i % 60}" for i in range(64)]
    want = [(x, y) for x in c for y in c if x != y] + [("x", "y"), ("y", "x")]
    got = resolve.siblings(e)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "parent" in plan(got) and plan(got).count("pmod") >= 2
    assert sorted(tuple(r) for r in resolve.siblings(e, spark.createDataFrame([("x",)], "node string")).collect()) == [("x", "y")]


def test_fused_edges_are_shuffled_without_buffers(spark):
    e = spark.createDataFrame([("a", "b", "Calls", 0.5, 1), ("a", "b", "Calls", 0.5, 0), ("a", "c", "Calls", 0.3, 0)], "source string, target string, relation string, confidence double, overlay_ord int")
    fused = fusion.fuse_edges(e.select("*", provenance().alias("provenance"), F.array(F.col("overlay_ord").cast("string")).alias("evidence")))
    text = plan(fused)
    assert text.count("Exchange") == 1 and text.index("partial_product") < text.index("Exchange")  # printed from the top: both steps follow the exchange
    assert {(r.target, round(r.confidence, 6), r.provenance.source, tuple(r.evidence)) for r in fused.collect()} == {("b", 0.75, "Consolidated", ("0", "1")), ("c", 0.3, "ToolOutput", ("0",))}


def test_equal_nodes_go_before_the_choice_sorts(spark):
    n = spark.createDataFrame([("a", "Calls", 1), ("a", "Contains", 0), ("a", "Calls", 1), ("b", None, 2)], "address string, relation string, overlay_ord int")
    one = fusion.dedup_nodes(n)
    assert plan(one).count(" HashAggregate(keys=[address") + plan(one).count("- HashAggregate(keys=[address") >= 2
    assert sorted((r.address, r.relation) for r in one.collect()) == [("a", "Contains"), ("b", None)]
    mapped = fusion.dedup_nodes(n.withColumn("m", F.create_map(F.lit("k"), "overlay_ord")))
    assert sorted((r.address, r.m["k"]) for r in mapped.collect()) == [("a", 0), ("b", 2)]
