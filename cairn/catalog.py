"""Registry of the engine's queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import testgraph as T
from cairn.functions import confidence as C
from cairn.functions import identity as I
from cairn.operators import belief, chain, changes, community, embedding, export, federation, fusion, governance, lineage, resolve, stats
from cairn.operators.graph import Graph, Query, top_scores
from cairn.plans.fixpoint import with_paths
from cairn.registry import QUERIES, SQL, query

ROOT, DEEP = "nation:3", "order:32"
Session, Rows = SparkSession, DataFrame


def _scores(df: DataFrame, *columns: str) -> DataFrame:
    """Scores rounded to six digits, as products are taken in another order elsewhere."""
    return df.select(*columns, F.round("score", 6).alias("score"))


def _seeds(spark: Session, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def _walk_sql(start: str, down: bool = True, least: float = 0.0, factor: float = 1.0, depth: int = 8) -> str:
    a, b = ("source", "target") if down else ("target", "source")
    return f"""walk(node, score, hop) AS (SELECT '{start}', 1.0::DOUBLE, 0 UNION ALL
      SELECT e.{b}, least(1.0, w.score * e.confidence * {factor}), w.hop + 1 FROM walk w JOIN edges e ON e.{a} = w.node
      WHERE w.hop < {depth} AND w.score > 0 AND least(1.0, w.score * e.confidence * {factor}) >= {least})"""


# Fusion and confidence


@query(f"WITH {T.EDGES_SQL} SELECT source, target, relation, round(confidence, 6) AS confidence, n FROM edges")
def fuse_edges(spark: Session, sf: str) -> Rows:
    e = fusion.fuse_confidence(T.raw_edges(spark, sf))
    return e.select("source", "target", "relation", F.round("confidence", 6).alias("confidence"), "n")


@query(
    f"""WITH {T.RAW_SQL}, o AS (SELECT *, CASE relation WHEN 'Contains' THEN 0 WHEN 'Calls' THEN 1 ELSE 2 END AS k FROM raw)
    SELECT source, target, relation, round(CASE WHEN count(*) = 1 THEN min(confidence) ELSE 1 - product(1 - confidence) END, 6) AS confidence,
    CASE WHEN count(*) = 1 THEN 'ToolOutput' ELSE 'Consolidated' END AS prov_source, CASE WHEN count(*) = 1 THEN min(relation) ELSE 'fusion' END AS actor, count(*) AS evidence FROM o GROUP BY source, target, relation"""
)
def fuse_overlays(spark: Session, sf: str) -> Rows:
    from cairn.schema import provenance

    raw = T.raw_edges(spark, sf).withColumn("provenance", provenance(actor=F.col("relation"))).withColumn("evidence", F.array("source"))
    overlays = [raw.where("relation = 'Contains'"), raw.where("relation = 'Calls'"), raw.where("relation not in ('Contains', 'Calls')")]
    e = fusion.fuse_edges(fusion.union_overlays(overlays))
    return e.select("source", "target", "relation", F.round("confidence", 6).alias("confidence"), F.col("provenance.source").alias("prov_source"), F.col("provenance.actor").alias("actor"), F.size("evidence").cast("bigint").alias("evidence"))


@query(f"WITH {T.RAW_SQL}, n AS (SELECT source AS id, relation FROM raw UNION ALL SELECT target, relation FROM raw) SELECT id AS address, min(relation) AS relation FROM n GROUP BY id")
def dedup_nodes(spark: Session, sf: str) -> Rows:
    raw = T.raw_edges(spark, sf)
    both = raw.select(F.col("source").alias("address"), "relation").unionByName(raw.select(F.col("target").alias("address"), "relation"))
    order = F.when(F.col("relation") == "Calls", 0).when(F.col("relation") == "Contains", 1).when(F.col("relation") == "Imports", 2).otherwise(3)
    return fusion.dedup_nodes(both.withColumn("overlay_ord", order))


@query("SELECT l_orderkey AS node, round(product(1 - l_discount), 6) AS path_confidence, round(1 - product(l_discount), 6) AS any_confidence FROM lineitem GROUP BY l_orderkey")
def path_confidence(spark: Session, sf: str) -> Rows:
    c = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), (1 - F.col("l_discount")).alias("c"))
    return c.groupBy("node").agg(F.round(C.path_product("c"), 6).alias("path_confidence"), F.round(C.noisy_or("c"), 6).alias("any_confidence"))


@query("SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100)) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 50)) AS score, least(value / 10, 1.0::DOUBLE) AS trace FROM events")
def impact_scores(spark: Session, sf: str) -> Rows:
    e = T.table(spark, sf, "events")
    return e.select("event_id", C.impact_score(F.col("value") / 100, F.col("value") / 50).alias("score"), C.trace_confidence(F.col("value")).alias("trace"))


@query(f"WITH {T.NODES_SQL} SELECT id, sha256(id) AS address, substr(sha256(id), 1, 8) AS short FROM nodes")
def node_address(spark: Session, sf: str) -> Rows:
    n = T.nodes(spark, sf).select(F.col("address").alias("id"))
    return n.select("id", I.address_of("id").alias("address"), I.short_address(I.address_of("id")).alias("short"))


@query(
    """SELECT p_partkey, sha256('file:' || p_name) AS file, sha256('sym:' || p_brand || ':' || p_type || ':' || p_name) AS symbol,
    sha256('stmt:' || p_brand || ':' || p_partkey || ':' || p_size) AS statement, sha256('process:' || p_name) AS process, sha256('canonical:Type:' || p_name) AS canonical FROM part"""
)
def derived_addresses(spark: Session, sf: str) -> Rows:
    p = T.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        I.file_address("p_name").alias("file"),
        I.symbol_address("p_brand", "p_type", "p_name").alias("symbol"),
        I.statement_address("p_brand", "p_partkey", "p_size").alias("statement"),
        I.process_address("p_name").alias("process"),
        I.canonical_address(F.lit("Type"), "p_name").alias("canonical"),
    )


# Filters and neighbourhoods


@query(
    f"""WITH {T.EDGES_SQL} SELECT target AS neighbor, relation, round(confidence, 6) AS confidence FROM edges WHERE source = '{DEEP}'
    UNION ALL SELECT source, relation, round(confidence, 6) FROM edges WHERE target = '{DEEP}'"""
)
def neighbors_both(spark: Session, sf: str) -> Rows:
    n = T.graph(spark, sf).neighbors(DEEP, I.Direction.BOTH)
    return n.select("neighbor", "relation", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {T.EDGES_SQL} SELECT source, target, relation, round(confidence, 6) AS confidence FROM edges WHERE (source LIKE 'nation:%' OR target LIKE 'nation:%')")
def edges_touching(spark: Session, sf: str) -> Rows:
    g = T.graph(spark, sf)
    e = g.edges_touching(g.nodes.where(F.col("address").startswith("nation:")).select("address"))
    return e.select("source", "target", "relation", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {T.EDGES_SQL} SELECT source, target, relation, round(confidence, 6) AS confidence FROM edges WHERE split_part(source, ':', 1) IN ('nation', 'region', 'supplier') AND split_part(target, ':', 1) IN ('nation', 'region', 'supplier')")
def induced_subgraph(spark: Session, sf: str) -> Rows:
    g = T.graph(spark, sf)
    kept = g.nodes.where(F.col("address").rlike("^(nation|region|supplier):")).select("address")
    return g.induced(kept).select("source", "target", "relation", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {T.EDGES_SQL} SELECT relation, count(*) AS edges FROM edges WHERE confidence >= 0.95 AND relation IN ('Imports', 'References') GROUP BY relation")
def filtered_edges(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).filtered_edges(("Imports", "References"), 0.95).groupBy("relation").agg(F.count("*").alias("edges"))


# Traversal


_FIRST = "SELECT node, min(hop) AS hop FROM walk GROUP BY node"


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(ROOT, depth=3)} {_FIRST}")
def bfs_levels(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).reach(Query(ROOT, max_depth=3)).select("node", "hop")


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql('part:7', down=False, depth=4)} {_FIRST}")
def bfs_upstream(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).reach(Query("part:7", I.Direction.UPSTREAM, 4)).select("node", "hop")


@query(f"WITH RECURSIVE {T.EDGES_SQL.replace('GROUP BY source, target, relation)', chr(39).join(['WHERE relation IN (', 'Contains', ', ', 'Calls', ') GROUP BY source, target, relation)']))}, {_walk_sql(ROOT, depth=4)} {_FIRST}")
def relation_filtered_bfs(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).reach(Query(ROOT, max_depth=4, relations=("Contains", "Calls"))).select("node", "hop")


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(ROOT, depth=4, least=0.68)} {_FIRST}")
def min_confidence_bfs(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).reach(Query(ROOT, max_depth=4, min_confidence=0.68)).select("node", "hop")


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(DEEP, depth=2)}, seen AS (SELECT DISTINCT node FROM walk)
    SELECT e.source, e.target, e.relation, round(e.confidence, 6) AS confidence FROM edges e JOIN seen a ON e.source = a.node JOIN seen b ON e.target = b.node"""
)
def execute_query(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).execute(Query(DEEP, max_depth=2)).edges.select("source", "target", "relation", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, p(node, hop, way, score) AS (SELECT '{DEEP}', 0, '{DEEP}', 1.0::DOUBLE UNION ALL
      SELECT e.target, p.hop + 1, p.way || '>' || e.target, p.score * e.confidence FROM p JOIN edges e ON e.source = p.node WHERE p.hop < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hop, score DESC, way) AS k FROM p) SELECT node, hop, way, round(score, 6) AS score FROM r WHERE k = 1 AND hop > 0"""
)
def bfs_paths(spark: Session, sf: str) -> Rows:
    r = with_paths(T.graph(spark, sf).reach(Query(DEEP, max_depth=3))).where("hop > 0")
    return r.select("node", "hop", F.array_join("path", ">").alias("way"), F.round("confidence", 6).alias("score"))


# Propagation


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(ROOT)}, s AS (SELECT node, round(max(score), 6) AS score FROM walk GROUP BY node) SELECT node, score FROM s WHERE score > 0.01 ORDER BY score DESC, node LIMIT 20")
def impact_downstream_topk(spark: Session, sf: str) -> Rows:
    return top_scores(_scores(T.graph(spark, sf).impact(_seeds(spark, ROOT)), "node"), 20)


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(ROOT)} SELECT node, round(max(score), 6) AS score FROM walk GROUP BY node")
def impact_downstream(spark: Session, sf: str) -> Rows:
    return _scores(T.graph(spark, sf).impact(_seeds(spark, ROOT)), "node")


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql('supplier:5', down=False)} SELECT node, round(max(score), 6) AS score FROM walk GROUP BY node")
def staleness_upstream(spark: Session, sf: str) -> Rows:
    return _scores(T.graph(spark, sf).staleness(_seeds(spark, "supplier:5")), "node")


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(DEEP)}, {_walk_sql(DEEP, down=False).replace('walk', 'back')}
    SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM walk UNION ALL SELECT * FROM back) GROUP BY node"""
)
def impact_both(spark: Session, sf: str) -> Rows:
    return _scores(T.graph(spark, sf).impact(_seeds(spark, DEEP), I.Direction.BOTH), "node")


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(ROOT, least=0.4, factor=0.85)} SELECT '{ROOT}' AS root, node, round(max(score), 6) AS score FROM walk GROUP BY node")
def depth_propagate(spark: Session, sf: str) -> Rows:
    return _scores(T.graph(spark, sf).attenuated(_seeds(spark, ROOT), 0.85, 0.4), "root", "node")


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, walk(root, node, score, hop) AS (SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 1.0::DOUBLE, 0 FROM nation UNION ALL
      SELECT w.root, e.target, w.score * e.confidence * 0.85, w.hop + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE w.hop < 8 AND w.score * e.confidence * 0.85 >= 0.5)
    SELECT root, count(DISTINCT node) AS reached FROM walk GROUP BY root"""
)
def propagation_depth(spark: Session, sf: str) -> Rows:
    g = T.graph(spark, sf)
    roots = g.nodes.where(F.col("address").startswith("nation:")).select(F.col("address").alias("node"))
    return g.attenuated(roots, 0.85, 0.5).groupBy("root").agg(F.count("*").alias("reached"))


@query(f"WITH RECURSIVE {T.EDGES_SQL}, {_walk_sql(ROOT)} SELECT node, max(hop) AS level FROM walk GROUP BY node")
def topo_levels(spark: Session, sf: str) -> Rows:
    return T.graph(spark, sf).topological(_seeds(spark, ROOT)).select("node", "level")


# Changes: hunks cover line ranges, orders play nodes with spans of lines


_SPANS_SQL = "spans AS (SELECT 'order:' || l_orderkey AS address, 's' || (l_orderkey % 7) AS path, min(l_partkey) AS a, min(l_partkey) + count(*) AS z FROM lineitem GROUP BY l_orderkey), hunks AS (SELECT 's' || (p_partkey % 7) AS path, p_partkey AS new_start, p_size AS new_lines FROM part)"


def _spans(spark: Session, sf: str) -> DataFrame:
    g = T.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), (F.min("l_partkey") + F.count("*")).alias("z"))
    span = F.struct(F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"), F.col("a").alias("start_line"), F.col("z").alias("end_line"))
    return g.select(T._id("order", "l_orderkey").alias("address"), F.concat(F.lit("s"), (F.col("l_orderkey") % 7).cast("string")).alias("path"), span.alias("span"))


def _hunks(spark: Session, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part")
    return p.select(F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("path"), F.col("p_partkey").alias("new_start"), F.col("p_size").alias("new_lines"))


_OVER = "s.a < h.new_start + h.new_lines AND s.z >= h.new_start"


@query(f"WITH {_SPANS_SQL} SELECT DISTINCT address FROM spans s JOIN hunks h ON s.path = h.path AND {_OVER}")
def changed_nodes(spark: Session, sf: str) -> Rows:
    s = _spans(spark, sf)
    return changes.changed_nodes(s, _hunks(spark, sf), s)


@query(f"WITH {_SPANS_SQL} SELECT DISTINCT address FROM spans s JOIN hunks h ON {_OVER}")
def changed_nodes_any_file(spark: Session, sf: str) -> Rows:
    return changes.changed_nodes(_spans(spark, sf), _hunks(spark, sf))


@query(f"WITH {T.EDGES_SQL}, {_SPANS_SQL}, c AS (SELECT DISTINCT address FROM spans s JOIN hunks h ON s.path = h.path AND {_OVER}) SELECT relation, count(*) AS edges FROM edges WHERE source IN (SELECT address FROM c) OR target IN (SELECT address FROM c) GROUP BY relation")
def affected_edges(spark: Session, sf: str) -> Rows:
    s = _spans(spark, sf)
    e = changes.affected_edges(T.graph(spark, sf), changes.changed_nodes(s, _hunks(spark, sf), s))
    return e.groupBy("relation").agg(F.count("*").alias("edges"))


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, {_SPANS_SQL}, c AS (SELECT DISTINCT address FROM spans s JOIN hunks h ON s.path = h.path AND {_OVER}),
    d(node, score, hop) AS (SELECT address, 1.0::DOUBLE, 0 FROM c UNION ALL SELECT e.target, d.score * e.confidence, d.hop + 1 FROM d JOIN edges e ON e.source = d.node WHERE d.hop < 6),
    u(node, score, hop) AS (SELECT address, 1.0::DOUBLE, 0 FROM c UNION ALL SELECT e.source, u.score * e.confidence, u.hop + 1 FROM u JOIN edges e ON e.target = u.node WHERE u.hop < 6)
    SELECT 'impact' AS side, node, round(max(score), 6) AS score FROM d GROUP BY node UNION ALL SELECT 'staleness', node, round(max(score), 6) FROM u GROUP BY node"""
)
def detect_changes(spark: Session, sf: str) -> Rows:
    s = _spans(spark, sf)
    got = changes.detect_changes(Graph(s, T.fused_edges(spark, sf)), _hunks(spark, sf), s)
    return _scores(got.impact.withColumn("side", F.lit("impact")).unionByName(got.staleness.withColumn("side", F.lit("staleness"))), "side", "node")


# Communities, lineage, federation


_BOND = "bond AS (SELECT source AS a, target AS b FROM edges WHERE relation = 'Calls' AND confidence >= 0.5 UNION ALL SELECT target, source FROM edges WHERE relation = 'Calls' AND confidence >= 0.5)"


@query(f"WITH RECURSIVE {T.EDGES_SQL} SELECT least(min(target), source) AS component_id, 1 + count(*) AS size, count(*) AS edge_count, round(avg(confidence), 6) AS avg_confidence FROM edges WHERE relation = 'Calls' GROUP BY source")
def components(spark: Session, sf: str) -> Rows:
    c = community.find_components(T.graph(spark, sf), ("Calls",))
    return c.select("component_id", "size", "edge_count", F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, e AS (SELECT source, target FROM edges WHERE relation = 'Imports' AND confidence >= 0.995),
    b AS (SELECT source AS a, target AS z FROM e UNION SELECT target, source FROM e),
    r(node, root) AS (SELECT a, a FROM b UNION SELECT b.z, r.root FROM r JOIN b ON r.node = b.a) SELECT node, min(root) AS root FROM r GROUP BY node"""
)
def component_members(spark: Session, sf: str) -> Rows:
    return community.component_labels(T.graph(spark, sf), ("Imports",), 0.995)


_RING = """ring AS (SELECT 'nation:' || n_nationkey AS source, 'nation:' || ((n_nationkey + 1) % 25) AS target, 0.9::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || ((n_nationkey * 7 + 3) % 25), 0.5 + n_nationkey / 100 FROM nation)"""


def _ring(spark: Session, sf: str) -> Graph:
    """A graph that is all cycles."""
    n = T.table(spark, sf, "nation")
    to = lambda e: F.concat(F.lit("nation:"), F.expr(e).cast("string")).alias("target")
    one = n.select(T._id("nation", "n_nationkey").alias("source"), to("(n_nationkey + 1) % 25"), F.lit("Calls").alias("relation"), F.lit(0.9).alias("confidence"))
    two = n.select(T._id("nation", "n_nationkey").alias("source"), to("(n_nationkey * 7 + 3) % 25"), F.lit("Calls").alias("relation"), (0.5 + F.col("n_nationkey") / 100).alias("confidence"))
    return Graph(n.select(T._id("nation", "n_nationkey").alias("address")), one.unionByName(two))


@query(f"WITH RECURSIVE {_RING}, walk(root, node, score) AS (SELECT source, source, 1.0::DOUBLE FROM ring UNION SELECT w.root, r.target, w.score * r.confidence FROM walk w JOIN ring r ON r.source = w.node WHERE w.score * r.confidence >= 0.3) SELECT root, node, round(max(score), 6) AS score FROM walk GROUP BY root, node")
def cyclic_impact(spark: Session, sf: str) -> Rows:
    g = _ring(spark, sf)
    return _scores(g.attenuated(g.nodes.select(F.col("address").alias("node")), 1.0, 0.3), "root", "node")


@query(f"WITH RECURSIVE {_RING}, walk(root, node, hop) AS (SELECT DISTINCT source, source, 0 FROM ring UNION SELECT w.root, r.target, w.hop + 1 FROM walk w JOIN ring r ON r.source = w.node WHERE w.hop < 12) SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node")
def cyclic_levels(spark: Session, sf: str) -> Rows:
    from cairn.plans.fixpoint import breadth_first

    g = _ring(spark, sf)
    return breadth_first(g.oriented(I.Direction.DOWNSTREAM), g.nodes.select(F.col("address").alias("node"))).select("root", "node", "hop")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey + 1 + c_custkey % 3 AS z FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT a, z FROM e UNION SELECT z, a FROM e),
    r(node, root) AS (SELECT a, a FROM b UNION SELECT b.z, r.root FROM r JOIN b ON r.node = b.a) SELECT 'c' || node AS node, 'c' || min(root) AS root FROM r GROUP BY node"""
)
def chained_components(spark: Session, sf: str) -> Rows:
    """Chains and forks of customers: components that no single grouping finds."""
    from cairn.plans.components import connected_components

    c = T.table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("bigint").alias("a"), F.expr("cast(c_custkey + 1 + c_custkey % 3 as bigint)").alias("b"))
    got = connected_components(c)
    return got.select(F.concat(F.lit("c"), F.col("node").cast("string")).alias("node"), F.concat(F.lit("c"), F.col("root").cast("string")).alias("root"))


_TRADE = "trade AS (SELECT DISTINCT 'nation:' || c_nationkey AS source, 'nation:' || s_nationkey AS target FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE abs(c_nationkey - s_nationkey) = 1)"


def _trade(spark: Session, sf: str) -> DataFrame:
    t = lambda n: T.table(spark, sf, n)
    j = t("customer").join(t("orders"), F.expr("c_custkey = o_custkey")).join(t("lineitem"), F.expr("l_orderkey = o_orderkey")).join(t("supplier"), F.expr("s_suppkey = l_suppkey"))
    j = j.where("abs(c_nationkey - s_nationkey) = 1")
    return j.select(T._id("nation", "c_nationkey").alias("source"), T._id("nation", "s_nationkey").alias("target")).distinct()


@query(
    f"""WITH RECURSIVE {_TRADE}, p(node, way, hop) AS (SELECT 'nation:2', ['nation:2'], 0 UNION ALL SELECT t.target, list_append(p.way, t.target), hop + 1 FROM p JOIN trade t ON t.source = p.node WHERE hop < 6 AND NOT list_contains(p.way, t.target)),
    w AS (SELECT way FROM p WHERE node = 'nation:6' ORDER BY hop LIMIT 1) SELECT i AS hop, way[i] AS source, way[i + 1] AS target FROM w, range(1, len(way)) AS t(i)"""
)
def trace_between(spark: Session, sf: str) -> Rows:
    return federation.trace_between(_trade(spark, sf), "nation:2", "nation:6").select(F.col("hop").cast("bigint").alias("hop"), "source", "target")


@query(
    f"""WITH RECURSIVE {_TRADE}, p(root, node, hop) AS (SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 FROM nation UNION SELECT p.root, t.target, hop + 1 FROM p JOIN trade t ON t.source = p.node WHERE hop < 30),
    d AS (SELECT root, node, min(hop) AS hop FROM p GROUP BY root, node) SELECT count(*) AS pairs, min(hop) AS min_depth, max(hop) AS max_depth, round(avg(hop), 6) AS mean_depth FROM d WHERE hop > 0"""
)
def trace_depth_stats(spark: Session, sf: str) -> Rows:
    nodes = T.table(spark, sf, "nation").select(T._id("nation", "n_nationkey").alias("node"))
    d = federation.trace_depths(_trade(spark, sf), nodes)
    return d.select("pairs", "min_depth", "max_depth", F.round("mean_depth", 6).alias("mean_depth"))


@query(
    """WITH RECURSIVE m AS (SELECT 'part:' || p_partkey AS child, 'part:' || (p_partkey // 2) AS parent FROM part WHERE p_partkey > 1),
    up(node, k) AS (SELECT 'part:20', 0 UNION ALL SELECT m.parent, k - 1 FROM up JOIN m ON m.child = up.node), down(node, k) AS (SELECT 'part:20', 0 UNION ALL SELECT m.child, k + 1 FROM down JOIN m ON m.parent = down.node)
    SELECT node, k AS position FROM up UNION SELECT node, k FROM down"""
)
def lineage_chain(spark: Session, sf: str) -> Rows:
    p = T.table(spark, sf, "part").where("p_partkey > 1")
    rec = p.select(T._id("part", "p_partkey").alias("child"), F.expr("concat('part:', p_partkey div 2)").alias("parent"), F.lit("test").alias("actor"), F.lit(0).alias("timestamp"))
    return lineage.lineage_chain(lineage.record_mutations(rec), "part:20")


@query(
    """WITH held AS (SELECT DISTINCT c_nationkey AS ord, 'repo' || c_nationkey AS repo, sha256(c_mktsegment) AS address FROM customer)
    SELECT x.address, x.repo AS a, y.repo AS b FROM held x JOIN held y ON x.address = y.address AND x.ord < y.ord"""
)
def identity_edges(spark: Session, sf: str) -> Rows:
    c = T.table(spark, sf, "customer")
    return federation.shared_addresses(c.select(F.col("c_nationkey").alias("repo_ord"), F.concat(F.lit("repo"), F.col("c_nationkey").cast("string")).alias("repo"), I.address_of("c_mktsegment").alias("address")))


@query(
    """WITH p AS (SELECT 'r' || n_nationkey AS repo, 'p' || n_nationkey AS package, ['p' || n_regionkey, 'p' || (n_nationkey + 1), 'other'] AS deps FROM nation), w AS (SELECT DISTINCT repo, unnest(deps) AS dep FROM p)
    SELECT sha256(w.repo) AS source, sha256(q.repo) AS target, 'References' AS relation FROM w JOIN p q ON q.package = w.dep WHERE w.repo <> q.repo"""
)
def dependency_edges(spark: Session, sf: str) -> Rows:
    n = T.table(spark, sf, "nation")
    p = n.select(F.expr("concat('r', n_nationkey)").alias("repo"), F.expr("concat('p', n_nationkey)").alias("package"), F.expr("array(concat('p', n_regionkey), concat('p', n_nationkey + 1), 'other')").alias("deps"))
    return federation.dependency_edges(p).select("source", "target", "relation")


@query(
    """WITH s AS (SELECT 'r' || (s_nationkey % 5) AS repo, 'sup' || (s_suppkey % 40) AS name, max_by(sha256(s_name), lpad(s_suppkey::VARCHAR, 9, '0')) AS address FROM supplier GROUP BY ALL),
    i AS (SELECT DISTINCT 'r' || (c_nationkey % 5) AS repo, 'c' || c_custkey AS path, 'sup' || (c_custkey % 50) AS name FROM customer)
    SELECT sha256('file:' || i.path) AS source, s.address AS target FROM i JOIN s ON s.name = i.name WHERE (i.repo = 'r0' AND s.repo = 'r1') OR (i.repo = 'r2' AND s.repo = 'r3')"""
)
def cross_repository_imports(spark: Session, sf: str) -> Rows:
    s = T.table(spark, sf, "supplier").select(F.expr("concat('r', s_nationkey % 5)").alias("repo"), F.lit("x").alias("lang"), F.expr("concat('sup', s_suppkey % 40)").alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("path"), F.lit(0).alias("ordinal"), I.address_of("s_name").alias("address"))
    i = T.table(spark, sf, "customer").select(F.expr("concat('r', c_nationkey % 5)").alias("repo"), F.lit("x").alias("lang"), F.expr("concat('c', c_custkey)").alias("path"), F.expr("concat('sup', c_custkey % 50)").alias("name"))
    d = spark.createDataFrame([("r0", "r1"), ("r2", "r3")], "repo string, other string")
    return federation.cross_repository_imports(i, s, d).select("source", "target")


# Joins


_SYMS = "sym AS (SELECT 'f' || (p_size % 10) AS path, split_part(p_name, ' ', 1) || (p_partkey % 60) AS name, sha256('part:' || p_partkey) AS address, p_partkey AS ordinal FROM part), refs AS (SELECT 'f' || (s_nationkey % 12) AS path, split_part(p_name, ' ', 1) || (s_suppkey % 70) AS name, s_suppkey FROM supplier JOIN part ON p_partkey = s_suppkey)"


def _symbols(spark: Session, sf: str) -> DataFrame:
    return T.table(spark, sf, "part").select(F.expr("concat('f', p_size % 10)").alias("path"), F.expr("concat(split_part(p_name, ' ', 1), p_partkey % 60)").alias("name"), I.address_of(T._id("part", "p_partkey")).alias("address"), F.col("p_partkey").alias("ordinal"))


@query(
    f"""WITH {_SYMS}, near AS (SELECT path, name, max_by(address, ordinal) AS address FROM sym GROUP BY path, name), uniq AS (SELECT name, min(address) AS address FROM sym GROUP BY name HAVING count(DISTINCT address) = 1)
    SELECT s_suppkey, r.path, r.name, coalesce(n.address, u.address) AS resolved FROM refs r LEFT JOIN near n ON n.path = r.path AND n.name = r.name LEFT JOIN uniq u ON u.name = r.name"""
)
def resolve_symbol(spark: Session, sf: str) -> Rows:
    s = T.table(spark, sf, "supplier").join(T.table(spark, sf, "part"), F.expr("p_partkey = s_suppkey"))
    refs = s.select(F.expr("concat('f', s_nationkey % 12)").alias("path"), F.expr("concat(split_part(p_name, ' ', 1), s_suppkey % 70)").alias("name"), "s_suppkey")
    return resolve.resolve_names(refs, _symbols(spark, sf)).select("s_suppkey", "path", "name", "resolved")


@query(
    f"""WITH {_SPANS_SQL}, pts AS (SELECT DISTINCT path, new_start AS line FROM hunks), h AS (SELECT p.path, line, s.address, s.z - s.a AS w FROM pts p JOIN spans s ON s.path = p.path AND line BETWEEN s.a AND s.z),
    r AS (SELECT *, rank() OVER (PARTITION BY path, line ORDER BY w) AS k FROM h) SELECT path, line, min(address) AS address, count(*) AS ties FROM r WHERE k = 1 GROUP BY path, line"""
)
def innermost_span(spark: Session, sf: str) -> Rows:
    pts = _hunks(spark, sf).select("path", F.col("new_start").alias("line")).distinct()
    return resolve.innermost_span(pts, _spans(spark, sf).select("path", "address", "span.start_line", "span.end_line"))


@query(f"WITH {T.EDGES_SQL}, c AS (SELECT source, target FROM edges WHERE relation = 'Contains') SELECT a.target AS node, b.target AS sibling FROM c a JOIN c b ON a.source = b.source AND a.target <> b.target")
def siblings(spark: Session, sf: str) -> Rows:
    return resolve.siblings(T.fused_edges(spark, sf))


@query(
    """WITH o AS (SELECT 'f' || c_custkey AS path, substr(sha256(c_name), 1, 16) AS hash FROM customer WHERE c_custkey % 10 <> 3), n AS (SELECT 'f' || c_custkey AS path, substr(sha256(CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_name END), 1, 16) AS hash FROM customer WHERE c_custkey % 10 <> 4)
    SELECT count(*) FILTER (o.path IS NULL OR n.path IS NULL OR o.hash <> n.hash) = 0 AS is_fresh, count(*) FILTER (o.hash <> n.hash) AS changed, count(*) FILTER (o.path IS NULL) AS added, count(*) FILTER (n.path IS NULL) AS removed FROM o FULL JOIN n ON o.path = n.path"""
)
def freshness_diff(spark: Session, sf: str) -> Rows:
    c = T.table(spark, sf, "customer")
    digest = lambda x: F.substring(I.address_of(x), 1, 16).alias("hash")
    path = F.expr("concat('f', c_custkey)").alias("path")
    old = c.where("c_custkey % 10 <> 3").select(path, digest("c_name"))
    new = c.where("c_custkey % 10 <> 4").select(path, digest(F.when(F.col("c_custkey") % 7 == 0, "new").otherwise(F.col("c_name"))))
    return resolve.freshness(old, new)


@query(
    """WITH d AS (SELECT l_orderkey AS path, l_linestatus AS name, l_partkey AS a, l_partkey + 5 AS z, l_linenumber * 1000000 + l_partkey AS k FROM lineitem), u AS (SELECT DISTINCT l_orderkey AS path, l_linestatus AS name, l_partkey + 100 AS a, l_partkey + 104 AS z FROM lineitem),
    m AS (SELECT u.path, u.name, u.a AS use_start, d.a AS def_start, row_number() OVER (PARTITION BY u.path, u.name, u.a, u.z ORDER BY d.k) AS r FROM u JOIN d ON u.path = d.path AND u.name = d.name AND u.a > d.z) SELECT path, name, use_start, def_start FROM m WHERE r = 1"""
)
def def_use_earliest(spark: Session, sf: str) -> Rows:
    n = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.lit(0).alias("scope"), F.col("l_linestatus").alias("name"), "l_partkey", "l_linenumber")
    d = n.select("path", "scope", "name", F.col("l_partkey").alias("start_byte"), (F.col("l_partkey") + 5).alias("end_byte"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"))
    u = n.select("path", "scope", "name", (F.col("l_partkey") + 100).alias("start_byte"), (F.col("l_partkey") + 104).alias("end_byte"))
    return resolve.def_use(d, u).select("path", "name", "use_start", "def_start")


@query(
    f"""WITH {_SYMS}, t AS (SELECT name, max_by(address, path || lpad(ordinal::VARCHAR, 12, '0')) AS address FROM sym GROUP BY name), tr AS (SELECT r.name AS caller, q.name AS callee, r.s_suppkey AS n FROM refs r JOIN refs q ON q.s_suppkey = r.s_suppkey + 1)
    SELECT a.address AS source, b.address AS target, round(least(n / 10, 1), 6) AS confidence FROM tr JOIN t a ON a.name = caller JOIN t b ON b.name = callee"""
)
def runtime_trace(spark: Session, sf: str) -> Rows:
    s = T.table(spark, sf, "supplier").join(T.table(spark, sf, "part"), F.expr("p_partkey = s_suppkey"))
    refs = s.select(F.expr("concat(split_part(p_name, ' ', 1), s_suppkey % 70)").alias("name"), "s_suppkey")
    pairs = refs.select(F.col("name").alias("caller"), "s_suppkey").join(refs.select(F.col("name").alias("callee"), (F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey")
    e = resolve.trace_edges(pairs.select("caller", "callee", F.col("s_suppkey").cast("string").alias("count")), _symbols(spark, sf))
    return e.select("source", "target", F.round("confidence", 6).alias("confidence"))


# Statistics: events play an experiment log


_RUNS = "runs AS (SELECT event_id AS iteration, user_id AS run, value AS fitness, value / 2 AS stability, CASE WHEN value = 0 THEN 'inconclusive' WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS status FROM events)"


def _runs(spark: Session, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    status = F.when(F.col("value") == 0, "inconclusive").when(F.col("event_type") == "error", "fail").otherwise("pass")
    return e.select(F.col("event_id").alias("iteration"), F.col("user_id").alias("run"), F.col("value").alias("fitness"), (F.col("value") / 2).alias("stability"), status.alias("status"), "event_type")


@query(
    f"""WITH {_RUNS}, s AS (SELECT list_sort(list(fitness)) AS v FROM runs) SELECT count(*) AS count, round(min(fitness), 6) AS min, round(max(fitness), 6) AS max, round(avg(fitness), 6) AS mean, round(stddev_pop(fitness), 6) AS std,
    round((SELECT v[floor((len(v) - 1) * 0.5 + 0.5)::INT + 1] FROM s), 6) AS median, round((SELECT v[floor((len(v) - 1) * 0.9 + 0.5)::INT + 1] FROM s), 6) AS p90 FROM runs"""
)
def experiment_stats(spark: Session, sf: str) -> Rows:
    s = stats.summary(_runs(spark, sf), "fitness")
    return s.select("count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "median", "p90")])


@query(f"WITH {_RUNS} SELECT status, count(*) AS n FROM runs GROUP BY status")
def experiment_status(spark: Session, sf: str) -> Rows:
    row = stats.status_counts(_runs(spark, sf))
    return row.select(F.explode(F.create_map(*[x for s in ("pass", "fail", "inconclusive") for x in (F.lit(s), F.col(s))])).alias("status", "n")).where("n > 0")


@query(
    """WITH p AS (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, 1.0::DOUBLE AS fixed, l_extendedprice AS f FROM lineitem), u AS (UNPIVOT p ON quantity, discount, tax, fixed INTO NAME parameter VALUE v)
    SELECT parameter, round(corr(v, f), 6) AS correlation FROM u WHERE parameter <> 'fixed' GROUP BY parameter"""
)
def param_correlation(spark: Session, sf: str) -> Rows:
    li = T.table(spark, sf, "lineitem")
    params = F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"), F.lit("fixed"), F.lit(1.0))
    c = stats.parameter_correlations(li.select(params.alias("params"), F.col("l_extendedprice").alias("fitness")))
    return c.select("parameter", F.round("correlation", 6).alias("correlation"))


@query(f"WITH {_RUNS}, w AS (SELECT run, fitness, max(fitness) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM runs) SELECT run, round(avg(CASE WHEN best IS NULL OR fitness > best THEN 1.0::DOUBLE ELSE 0 END), 6) AS convergence_rate FROM w GROUP BY run")
def convergence_rate(spark: Session, sf: str) -> Rows:
    c = stats.convergence_rate(_runs(spark, sf), run="run")
    return c.select("run", F.round("convergence_rate", 6).alias("convergence_rate"))


@query(
    f"""WITH {_RUNS}, b AS (SELECT *, fitness > coalesce(max(fitness) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) AS up FROM runs),
    g AS (SELECT *, count(*) FILTER (up) OVER (PARTITION BY run ORDER BY iteration) AS era FROM b), c AS (SELECT *, count(*) FILTER (NOT up) OVER (PARTITION BY run, era ORDER BY iteration) AS idle FROM g)
    SELECT run, iteration, CASE WHEN idle = 0 OR idle % 10 <> 0 THEN 'Continue' WHEN (idle / 10) % 3 = 0 THEN 'Restart' ELSE 'Widen' END AS action FROM c"""
)
def plateau_review(spark: Session, sf: str) -> Rows:
    from cairn.operators.experiment import review_log

    return review_log(_runs(spark, sf))


@query(f"WITH {T.EDGES_SQL}, {T.NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, least(1.0, (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes)) AS density")
def graph_density(spark: Session, sf: str) -> Rows:
    return stats.graph_density(T.nodes(spark, sf), T.fused_edges(spark, sf))


@query(f"WITH {T.EDGES_SQL}, {T.NODES_SQL}, n AS (SELECT split_part(id, ':', 1) AS overlay, count(*) AS nodes FROM nodes GROUP BY 1), e AS (SELECT split_part(source, ':', 1) AS overlay, count(*) AS edges FROM edges GROUP BY 1) SELECT coalesce(n.overlay, e.overlay) AS overlay, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM n FULL JOIN e ON n.overlay = e.overlay")
def overlay_counts(spark: Session, sf: str) -> Rows:
    of = lambda df, c: df.withColumn("overlay", F.split_part(F.col(c), F.lit(":"), F.lit(1)))
    return stats.overlay_counts(of(T.nodes(spark, sf), "address"), of(T.fused_edges(spark, sf), "source"))


@query(f"WITH {_TRADE} SELECT round((SELECT count(*) FROM trade)::DOUBLE / ((SELECT count(*) FROM nation) * ((SELECT count(*) FROM nation) - 1)), 6) AS coverage")
def workspace_coverage(spark: Session, sf: str) -> Rows:
    return stats.repository_coverage(T.table(spark, sf, "nation"), _trade(spark, sf)).select(F.round("coverage", 6).alias("coverage"))


@query(f"WITH {T.EDGES_SQL}, f AS (SELECT source, count(*) AS n FROM edges WHERE relation = 'Calls' GROUP BY source HAVING count(*) > 1) SELECT e.source, e.target FROM edges e JOIN f ON e.source = f.source WHERE relation = 'Calls'")
def branch_targets(spark: Session, sf: str) -> Rows:
    from cairn.operators.overlays import branch_targets as targets

    return targets(T.fused_edges(spark, sf).where("relation = 'Calls'")).select("source", "target")


# Chains and governance


#: Every user has a log; every 37th event was changed after it was written, so its own row fails and no other.
_CHAIN = """c AS (SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type || ':' || event_id AS row, event_id % 37 = 0 AS forged FROM events),
    h(log, pos, chain_hash) AS (SELECT log, 0::BIGINT, 'g' FROM c WHERE pos = 1 UNION ALL SELECT c.log, c.pos, substr(sha256(c.row || h.chain_hash), 1, 16) FROM h JOIN c ON c.log = h.log AND c.pos = h.pos + 1),
    k AS (SELECT h.log, h.pos, CASE WHEN c.forged THEN 'forged' ELSE c.row END AS row, h.chain_hash, p.chain_hash AS prev FROM h JOIN c ON c.log = h.log AND c.pos = h.pos JOIN h p ON p.log = h.log AND p.pos = h.pos - 1)"""


def _logs(spark: Session, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("log"), "event_id", F.concat_ws(":", "event_type", "event_id").alias("row"))
    linked = chain.link(e, "g", order="event_id", log="log")
    return linked.withColumn("row", F.when(F.col("event_id") % 37 == 0, "forged").otherwise(F.col("row")))


@query(f"WITH RECURSIVE {_CHAIN} SELECT log, pos, chain_hash FROM h WHERE pos > 0")
def chain_append(spark: Session, sf: str) -> Rows:
    return _logs(spark, sf).select("log", "pos", "chain_hash")


@query(f"WITH RECURSIVE {_CHAIN} SELECT log, pos, substr(sha256(row || prev), 1, 16) AS expected, substr(sha256(row || prev), 1, 16) = chain_hash AS ok FROM k")
def chain_verify(spark: Session, sf: str) -> Rows:
    return chain.verify(_logs(spark, sf), "g", log="log").select("log", "pos", "expected", "ok")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'Deny' WHEN o_orderpriority LIKE '2%' AND o_totalprice::BIGINT > 100000 THEN 'RequireApproval' WHEN o_orderpriority LIKE '2%' AND o_custkey < 50 THEN 'Deny' ELSE 'Allow' END AS decision FROM orders"""
)
def policy_decision(spark: Session, sf: str) -> Rows:
    rules = [governance.Rule("op1", "always", "deny"), governance.Rule("op2", "impact_nodes > 100000", "require-approval"), governance.Rule("op2", "changed_files < 50", "deny"), governance.Rule("op3", "impact_nodes <= 5", "deny")]
    o = T.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("op"), F.substring("o_orderpriority", 1, 1)).alias("operation"), F.round("o_totalprice").cast("bigint").alias("impact_nodes"), F.col("o_custkey").alias("changed_files"))
    return governance.decide(o, governance.rules_frame(spark, rules)).select("o_orderkey", "decision")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Deny' WHEN c_custkey % 5 = 0 THEN 'Deny' WHEN c_acctbal / 10000 < 0.5 THEN 'Deny' ELSE 'Allow' END AS decision,
    CASE WHEN c_custkey % 11 = 0 THEN 'actor is empty' WHEN c_custkey % 5 = 0 THEN 'index is stale' WHEN c_acctbal / 10000 < 0.5 THEN 'confidence is low' ELSE '' END AS reason FROM customer"""
)
def write_gate(spark: Session, sf: str) -> Rows:
    c = T.table(spark, sf, "customer")
    gate = governance.write_gate(F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("c_name")), F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 10000)
    return c.select("c_custkey", gate.alias("g")).select("c_custkey", "g.decision", "g.reason")


# Embeddings, beliefs, export


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q WHERE vec_id <> 7
    ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10"""
)
def k_nearest(spark: Session, sf: str) -> Rows:
    return embedding.k_nearest(T.table(spark, sf, "embeddings"), 7, 10, "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


def _beliefs(spark: Session, sf: str) -> tuple[DataFrame, DataFrame]:
    la = T.table(spark, sf, "labels").where("quality is not null and toxic is not null")
    return belief.create_beliefs(
        la.select(
            F.concat(F.lit("claim "), F.col("doc_id").cast("string")).alias("claim"),
            F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("subject"),
            (0.5 + F.col("quality") / 4).alias("confidence"),
            F.concat(F.lit("actor"), (F.col("doc_id") % 2).cast("string")).alias("actor"),
            F.lit(0).alias("timestamp"),
            F.when(F.col("quality") == 1, F.array(F.lit("good"), F.lit("kept"))).otherwise(F.array().cast("array<string>")).alias("supports"),
            F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("contradicts"),
        )
    )


@query("SELECT sha256('belief:claim ' || doc_id) AS address, 0.5 + quality / 4 AS confidence, 1 + 2 * quality + toxic AS edges FROM labels WHERE doc_id % 3 = 1 AND quality IS NOT NULL AND toxic IS NOT NULL")
def beliefs_about(spark: Session, sf: str) -> Rows:
    return belief.beliefs_about(*_beliefs(spark, sf), "s1").select("address", "confidence", F.size("edges").alias("edges"))


@query("SELECT sha256('belief:claim ' || doc_id) AS address, CASE WHEN quality = 1 THEN 'good' END AS justification FROM labels WHERE doc_id % 2 = 0 AND quality IS NOT NULL AND toxic IS NOT NULL")
def beliefs_by_actor(spark: Session, sf: str) -> Rows:
    return belief.beliefs_by_actor(_beliefs(spark, sf)[0], "actor0").select("address", F.col("provenance.justification").alias("justification"))


@query(
    f"""WITH {T.EDGES_SQL}, {T.NODES_SQL} SELECT '{{"data":{{"id":"' || id || '","kind":"Symbol","confidence":1.0,"label":"Symbol"}}}}' AS json FROM nodes
    UNION ALL SELECT '{{"data":{{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '","confidence":1.0}}}}' FROM edges WHERE relation = 'Contains'"""
)
def cytoscape_export(spark: Session, sf: str) -> Rows:
    g = T.graph(spark, sf)
    n, e = export.cytoscape_rows(g.nodes, g.edges, 0.5, ("Contains",))
    return n.unionByName(e)


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}' AS json, 'kind=' || printf('%.3f', value) AS params FROM events")
def params_text(spark: Session, sf: str) -> Rows:
    e = T.table(spark, sf, "events")
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return e.select("event_id", I.params_json(m).alias("json"), I.format_params(F.create_map(F.lit("kind"), F.col("value"))).alias("params"))


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations QUALIFY next_turn IS NOT NULL")
def sequential_edges(spark: Session, sf: str) -> Rows:
    from cairn.operators.overlays import sequential

    return sequential(T.table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", "next_turn")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cairn import catalog_code  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from cairn import catalog_code  # noqa: F401

    return dict(SQL)
