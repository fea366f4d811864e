"""Hand-built graphs with known scores, and random ones against a plain interpreter."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import confidence as C
from cairn.functions import identity as I
from cairn.operators import belief, changes, community, embedding, export, federation, fusion, lineage
from cairn.operators.graph import Graph, Query
from cairn.schema import EDGES, NODES, edge_columns, provenance


def graph(spark, edges, extra=()):
    rows = spark.createDataFrame([(s, t, float(c), r) for s, t, c, r in edges], "s string, t string, c double, r string")
    e = rows.select(*edge_columns(F.col("s"), F.col("t"), "Calls", F.col("c"))).withColumn("relation", F.lit("Calls"))
    e = rows.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("r").alias("relation"), F.col("c").alias("confidence"), provenance().alias("provenance"), F.array().cast("array<string>").alias("evidence"))
    names = sorted({x for s, t, *_ in edges for x in (s, t)} | set(extra))
    prov = ("ToolOutput", "test", 0, None)
    nodes = spark.createDataFrame([(n, "Symbol", prov, 1.0, 0, n, None) for n in names], NODES)
    return Graph(nodes, e)


def scores(df):
    return {r["node"]: round(r["score"], 9) for r in df.collect()}


CHAIN = [("A", "B", 0.5, "Calls"), ("B", "C", 0.5, "Calls")]
DIAMOND = [("A", "B", 0.9, "Calls"), ("A", "C", 0.5, "Calls"), ("B", "D", 0.8, "Calls"), ("C", "D", 0.3, "Calls")]


def test_chain_all_directions(spark):
    g = graph(spark, CHAIN, ["X"])
    assert scores(g.impact(g.roots("A"))) == {"A": 1, "B": 0.5, "C": 0.25}
    assert scores(g.staleness(g.roots("C"))) == {"C": 1, "B": 0.5, "A": 0.25}
    assert scores(g.impact(g.roots("B"), I.Direction.BOTH)) == {"A": 0.5, "B": 1, "C": 0.5}
    empty = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert scores(empty.impact(empty.roots("A"))) == {"A": 1}


def test_diamond_cycle_and_zero(spark):
    g = graph(spark, DIAMOND)
    assert scores(g.impact(g.roots("A")))["D"] == 0.72
    levels = {r["node"]: r["level"] for r in g.topological(g.roots("A")).collect()}
    assert levels == {"A": 0, "B": 1, "C": 1, "D": 2}
    g = graph(spark, [*DIAMOND, ("D", "A", 0.9, "Calls")])
    assert scores(g.impact(g.roots("A"))) == {"A": 1, "B": 0.9, "C": 0.5, "D": 0.72}
    assert len(g.topological(g.roots("A")).collect()) == 4
    g = graph(spark, [("A", "B", 0.0, "Calls"), ("B", "C", 1.0, "Calls")])
    assert scores(g.impact(g.roots("A"))) == {"A": 1, "B": 0}


def test_traversal(spark):
    g = graph(spark, [("A", "B", 0.3, "Calls"), ("B", "C", 1.0, "Calls"), ("A", "D", 1.0, "Imports"), ("D", "B", 0.9, "Imports")])
    hops = lambda **k: {r["node"]: r["hop"] for r in g.reach(Query("A", **k)).collect()}
    assert hops(max_depth=1) == {"A": 0, "B": 1, "D": 1}
    assert hops(max_depth=9, relations=("Calls",)) == {"A": 0, "B": 1, "C": 2}
    # pruned on the weak way, accepted later on the strong one
    assert hops(max_depth=9, min_confidence=0.5) == {"A": 0, "D": 1, "B": 2, "C": 3}
    got = g.execute(Query("A", max_depth=1))
    assert got.nodes.count() == 3 and got.edges.count() == 3 and got.paths.count() == 2
    assert g.neighbors("B", I.Direction.BOTH).count() == 3 and g.neighbors("A", min_confidence=0.5).count() == 1


def test_random_graphs_against_an_interpreter(spark):
    rng = random.Random(4)
    for _ in range(2):
        names = "ABCDEFGH"
        edges = [(a, b, rng.choice([0.3, 0.5, 0.9, 1.0]), "Calls") for a, b in itertools.permutations(names, 2) if rng.random() < 0.25]
        g = graph(spark, edges, names)
        best = {"A": 1.0}
        for _ in range(len(names)):
            for s, t, c, _ in edges:
                if s in best:
                    best[t] = max(best.get(t, -1), best[s] * c)
        assert scores(g.impact(g.roots("A"))) == {k: round(v, 9) for k, v in best.items()}
        up = graph(spark, [(t, s, c, r) for s, t, c, r in edges], names)
        assert scores(up.staleness(up.roots("A"))) == {k: round(v, 9) for k, v in best.items()}


def test_fusion(spark):
    a, b = graph(spark, [("a", "b", 0.6, "Calls")]), graph(spark, [("a", "b", 0.4, "Calls"), ("a", "b", 0.5, "Imports")])
    both = fusion.union_overlays([a.edges, b.edges])
    got = {(r.source, r.target, r.relation): r for r in fusion.fuse_edges(both).collect()}
    assert got["a", "b", "Calls"].confidence == pytest.approx(0.76)
    assert got["a", "b", "Calls"].provenance.actor == "fusion" and got["a", "b", "Imports"].provenance.actor == "test"
    assert fusion.dedup_nodes(fusion.union_overlays([a.nodes, b.nodes])).count() == 2
    row = spark.createDataFrame([], "c double").agg(C.noisy_or("c").alias("n"), C.path_product("c").alias("p")).first()
    assert (row.n, row.p) == (0.0, 1.0)


def test_communities(spark):
    edges = [("A", "B", 1.0, "Calls"), ("C", "D", 1.0, "Calls")]
    assert sorted(r["size"] for r in community.find_components(graph(spark, edges)).collect()) == [2, 2]
    g = graph(spark, [*edges, ("B", "C", 0.4, "Imports")])
    assert [r["size"] for r in community.module_clusters(g).collect()] == [4]
    assert community.find_components(g, ("Calls", "Imports"), 0.5).count() == 2


def test_lineage(spark):
    rec = spark.createDataFrame([("A", "B", "me", 1), ("B", "C", "me", 2)], "parent string, child string, actor string, timestamp bigint")
    e = lineage.record_mutations(rec)
    order = lambda df: [r["node"] for r in df.orderBy("position").collect()]
    assert order(lineage.lineage_chain(e, "B")) == ["A", "B", "C"] and order(lineage.lineage_chain(e, "Z")) == []
    loop = lineage.record_mutations(spark.createDataFrame([("A", "B", "me", 1), ("B", "A", "me", 2)], rec.schema))
    assert {r["node"] for r in lineage.ancestors(loop, "A").collect()} == {"B"}


def test_changes(spark):
    n = spark.createDataFrame([("a", "x.rs", (0, 0, 1, 6)), ("b", "x.rs", (0, 0, 20, 25)), ("c", "y.rs", (0, 0, 1, 9))], "address string, path string, span struct<start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint>")
    h = spark.createDataFrame([("x.rs", 3, 2)], "path string, new_start bigint, new_lines bigint")
    assert {r.address for r in changes.changed_nodes(n, h, n).collect()} == {"a"}
    assert {r.address for r in changes.changed_nodes(n, h).collect()} == {"a", "c"}
    assert changes.changed_nodes(n, h.limit(0), n).count() == 0


def test_beliefs_embeddings_export(spark):
    specs = spark.createDataFrame([("fn_x is dead", "x", 0.8, "me", 1, ["ev"], ["no"])], "claim string, subject string, confidence double, actor string, timestamp bigint, supports array<string>, contradicts array<string>")
    nodes, edges = belief.create_beliefs(specs)
    assert belief.beliefs_about(nodes, edges, "x").count() == 1 and belief.beliefs_by_actor(nodes, "me").first().provenance.justification == "ev"
    assert [r.target for r in belief.evidence_for(edges, I.address("belief:fn_x is dead"), "Contradicts").collect()] == ["no"]
    v = spark.createDataFrame([("q", [1.0, 0.0]), ("close", [0.9, 0.1]), ("far", [0.0, 1.0]), ("zero", [0.0, 0.0])], "address string, vector array<float>")
    assert [r.address for r in embedding.k_nearest(v, "q", 2).collect()] == ["close", "far"]
    assert embedding.k_nearest(v, "none", 2).count() == 0
    g = graph(spark, [("A", "B", 0.9, "Calls"), ("B", "C", 0.5, "Calls")])
    assert export.cytoscape_json(g.nodes, g.edges, 0.8).count('"source"') == 1


def test_federation(spark):
    local, link = graph(spark, [("fn", "caller", 1.0, "Calls")]), graph(spark, [("caller", "helper", 0.7, "Imports")])
    g = federation.federated([local, graph(spark, [], ["helper"])], link.edges)
    assert g.reach(Query("fn", max_depth=10)).count() == 3
    assert g.reach(Query("fn", max_depth=10, min_confidence=0.8)).count() == 2
    assert federation.trace_between(g.edges, "fn", "helper").count() == 2 and federation.trace_between(g.edges, "fn", "fn").count() == 0
