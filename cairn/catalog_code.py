"""Queries over source code, overlays and the experiment engine, with the SQL that gives the same rows.

The sources are made from the suppliers (`cairn.testsources`); the SQL states what a reader must find in them and joins
that, and never runs a reader itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import testgraph as T
from cairn import testsources as S
from cairn.extract import local, pipeline
from cairn.functions import confidence as C
from cairn.functions import identity as I
from cairn.operators import chain, community, evidence, experiment, federation, overlays, resolve, stats
from cairn.operators.graph import Graph, top_scores
from cairn.plans.checkpoint import cut_unsized
from cairn.registry import query
from cairn.schema import edge_columns, provenance

Session, Rows = SparkSession, DataFrame
IR = S.facts_sql()
_PLACE = ("path", "start_byte", "end_byte")


def _ir(spark: Session, sf: str) -> DataFrame:
    return cut_unsized(pipeline.extract(S.files(spark, sf)))


# Readers


@query(f"WITH {IR} SELECT path, name, extra AS kind, syntax_kind, start_byte, end_byte, start_line, end_line FROM ir WHERE kind = 'symbol'")
def extract_symbols(spark: Session, sf: str) -> Rows:
    s = pipeline.extract(S.files(spark, sf)).where("kind = 'symbol'")
    return s.select("path", "name", F.col("extra").alias("kind"), "syntax_kind", "start_byte", "end_byte", "start_line", "end_line")


@query(f"WITH {IR} SELECT path, name, start_byte, end_byte FROM ir WHERE kind = 'import'")
def extract_imports(spark: Session, sf: str) -> Rows:
    return pipeline.extract(S.files(spark, sf)).where("kind = 'import'").select("path", "name", "start_byte", "end_byte")


@query(f"WITH {IR} SELECT path, name, start_byte, end_byte, other_start AS caller_start, other_end AS caller_end FROM ir WHERE kind = 'call'")
def extract_calls(spark: Session, sf: str) -> Rows:
    c = pipeline.extract(S.files(spark, sf)).where("kind = 'call'")
    return c.select(*_PLACE, "name", F.col("other_start").alias("caller_start"), F.col("other_end").alias("caller_end"))


@query(f"WITH {IR} SELECT path, name AS type_name, extra AS trait_name FROM ir WHERE kind = 'impl'")
def extract_impls(spark: Session, sf: str) -> Rows:
    return pipeline.extract(S.files(spark, sf)).where("kind = 'impl'").select("path", F.col("name").alias("type_name"), F.col("extra").alias("trait_name"))


@query(f"WITH {IR} SELECT path, extra AS flow, start_byte, end_byte, other_start, other_end FROM ir WHERE kind = 'control'")
def extract_control(spark: Session, sf: str) -> Rows:
    c = pipeline.extract(S.files(spark, sf)).where("kind = 'control'")
    return c.select(*_PLACE, F.col("extra").alias("flow"), "other_start", "other_end")


@query(f"WITH {IR} SELECT path, kind, name, start_byte, end_byte FROM ir WHERE kind IN ('def', 'use')")
def extract_names(spark: Session, sf: str) -> Rows:
    return pipeline.extract(S.files(spark, sf)).where("kind in ('def', 'use')").select(*_PLACE, "kind", "name")


@query(f"WITH {IR} SELECT name, sha256('sym:' || path || ':function_item:' || name) AS address FROM ir WHERE kind = 'entry'")
def entrypoints(spark: Session, sf: str) -> Rows:
    return pipeline.entrypoints(pipeline.extract(S.files(spark, sf)))


_DATA = """u AS (SELECT * FROM ir WHERE kind = 'use'), d AS (SELECT * FROM ir WHERE kind = 'def'),
    data AS (SELECT u.path, u.name, u.start_byte AS use_start, u.end_byte AS use_end, min(d.start_byte) AS def_start, min(d.end_byte) AS def_end FROM u JOIN d ON u.path = d.path AND u.name = d.name AND u.start_byte > d.end_byte GROUP BY ALL)"""


@query(f"WITH {IR}, {_DATA} SELECT path, name, use_start, def_start FROM data")
def data_flow(spark: Session, sf: str) -> Rows:
    ir = _ir(spark, sf)
    return resolve.def_use(ir.where("kind = 'def'"), ir.where("kind = 'use'")).select("path", "name", "use_start", "def_start")


# Overlays

_SYM = "sym AS (SELECT path, name, 'sym:' || path || ':' || syntax_kind || ':' || name AS pre, start_byte, end_byte FROM ir WHERE kind = 'symbol'), uniq AS (SELECT name, min(pre) AS pre FROM sym GROUP BY name HAVING count(DISTINCT pre) = 1)"
_RESOLVED = "coalesce(n.pre, q.pre)"
#: Symbols of one name in a file differ in nothing else here, so the last one is the only one.
_SEMANTIC = f"""sem AS (
    SELECT sha256('file:' || r.path) AS source, sha256({_RESOLVED}) AS target, 'Imports' AS relation, 0.8::DOUBLE AS confidence FROM ir r LEFT JOIN sym n ON n.path = r.path AND n.name = r.name LEFT JOIN uniq q ON q.name = r.name WHERE r.kind = 'import' AND {_RESOLVED} IS NOT NULL
    UNION ALL SELECT sha256(c.pre), sha256({_RESOLVED}), 'Calls', 0.7 FROM ir r JOIN sym c ON c.path = r.path AND c.start_byte = r.other_start AND c.end_byte = r.other_end LEFT JOIN sym n ON n.path = r.path AND n.name = r.name LEFT JOIN uniq q ON q.name = r.name WHERE r.kind = 'call' AND {_RESOLVED} IS NOT NULL
    UNION ALL SELECT sha256(o.pre), sha256(n.pre), 'Implements', 0.8 FROM ir r JOIN sym o ON o.path = r.path AND o.name = r.name JOIN sym n ON n.path = r.path AND n.name = r.extra WHERE r.kind = 'impl')"""
_CONTAINS = "con AS (SELECT sha256('file:' || path) AS source, sha256(pre) AS target, 'Contains' AS relation, 1.0::DOUBLE AS confidence FROM sym)"
_STMT = "sha256('stmt:' || path || ':' || {} || ':' || {})"
_FLOWS = f"""flo AS (SELECT {_STMT.format('start_byte', 'end_byte')} AS source, {_STMT.format('other_start', 'other_end')} AS target, 'ControlFlow' AS relation, 1.0::DOUBLE AS confidence FROM ir WHERE kind = 'control'
    UNION ALL SELECT {_STMT.format('def_start', 'def_end')}, {_STMT.format('use_start', 'use_end')}, 'DataFlow', 1.0 FROM data)"""
_ALL = f"{IR}, {_DATA}, {_SYM}, {_SEMANTIC}, {_CONTAINS}, {_FLOWS}, every AS (SELECT * FROM sem UNION ALL SELECT * FROM con UNION ALL SELECT * FROM flo), fused AS (SELECT source, target, relation, round(CASE WHEN count(*) = 1 THEN min(confidence) ELSE 1 - product(1 - confidence) END, 6) AS confidence FROM every GROUP BY source, target, relation)"


def _edges(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "relation", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {IR}, {S.files_sql()}, {_SYM} SELECT sha256('file:' || path) AS address, 'File' AS kind, sha256(content) AS content_hash, NULL::BIGINT AS start_line FROM src UNION ALL SELECT sha256(s.pre), 'Symbol', sha256(substr(f.content, s.start_byte + 1, s.end_byte - s.start_byte)), i.start_line FROM sym s JOIN src f ON f.path = s.path JOIN ir i ON i.path = s.path AND i.kind = 'symbol' AND i.start_byte = s.start_byte AND i.name = s.name")
def syntax_nodes(spark: Session, sf: str) -> Rows:
    files = S.files(spark, sf)
    nodes, _ = pipeline.syntax(files, pipeline.extract(files))
    return nodes.select("address", "kind", "content_hash", "span.start_line")


@query(f"WITH {IR}, {_SYM}, {_CONTAINS} SELECT * FROM con")
def syntax_edges(spark: Session, sf: str) -> Rows:
    files = S.files(spark, sf)
    return _edges(pipeline.syntax(files, pipeline.extract(files))[1])


@query(f"WITH {IR}, {_SYM}, {_SEMANTIC} SELECT * FROM sem")
def semantic_edges(spark: Session, sf: str) -> Rows:
    return _edges(pipeline.semantic(_ir(spark, sf)))


@query(f"WITH {IR}, {_DATA}, {_FLOWS} SELECT * FROM flo")
def flow_edges(spark: Session, sf: str) -> Rows:
    return _edges(pipeline.flow(_ir(spark, sf))[1])


@query(f"WITH {IR}, {_DATA}, {_FLOWS} SELECT DISTINCT address FROM (SELECT source AS address FROM flo UNION ALL SELECT target FROM flo)")
def flow_nodes(spark: Session, sf: str) -> Rows:
    return pipeline.flow(_ir(spark, sf))[0].select("address")


@query(f"WITH {_ALL} SELECT * FROM fused")
def fused_index(spark: Session, sf: str) -> Rows:
    return _edges(pipeline.index(S.files(spark, sf)).edges)


@query(f"WITH {IR}, {_DATA}, {_FLOWS}, br AS (SELECT source FROM flo WHERE relation = 'ControlFlow' GROUP BY source HAVING count(*) > 1) SELECT source, target, 'ControlDependence' AS relation FROM flo WHERE relation = 'ControlFlow' AND source IN (SELECT source FROM br) UNION ALL SELECT source, target, relation FROM flo WHERE relation = 'DataFlow'")
def dependence_overlay(spark: Session, sf: str) -> Rows:
    return overlays.dependence_edges(pipeline.flow(_ir(spark, sf))[1]).select("source", "target", "relation")


_PROCESS = """ent AS (SELECT name, sha256('sym:' || path || ':function_item:' || name) AS address FROM ir WHERE kind = 'entry'), calls AS (SELECT DISTINCT source, target FROM sem WHERE relation = 'Calls'),
    w(root, node, hop) AS (SELECT address, address, 0 FROM ent UNION SELECT w.root, c.target, hop + 1 FROM w JOIN calls c ON c.source = w.node WHERE hop < 10), f AS (SELECT root, node, min(hop) AS hop FROM w GROUP BY root, node)"""


@query(f"WITH RECURSIVE {IR}, {_SYM}, {_SEMANTIC}, {_PROCESS} SELECT f.node AS source, sha256('process:' || e.name) AS target, round(pow(0.9, f.hop), 6) AS confidence FROM f JOIN ent e ON e.address = f.root")
def process_overlay(spark: Session, sf: str) -> Rows:
    ir = _ir(spark, sf)
    _, edges = overlays.process_overlay(pipeline.entrypoints(ir), pipeline.semantic(ir))
    return edges.select("source", "target", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {IR}, {_SYM}, {_SEMANTIC} SELECT DISTINCT source, target FROM sem WHERE relation = 'Calls'")
def call_graph(spark: Session, sf: str) -> Rows:
    return overlays.call_graph(pipeline.semantic(_ir(spark, sf)))


_OCC = "occ AS (SELECT 'd' || (l_orderkey % 50) AS relative_path, 'x' || (l_partkey % 40) AS symbol, CASE WHEN l_linenumber = 1 THEN 'definition' ELSE 'reference' END AS role, l_orderkey * 10 + l_linenumber AS line FROM lineitem)"


@query(f"WITH {_OCC}, d AS (SELECT DISTINCT relative_path, symbol FROM occ WHERE role = 'definition') SELECT sha256('scip-ref:' || o.relative_path || ':' || line) AS source, sha256('scip:' || o.symbol) AS target FROM occ o JOIN d ON d.relative_path = o.relative_path AND d.symbol = o.symbol WHERE role <> 'definition'")
def scip_overlay(spark: Session, sf: str) -> Rows:
    li = T.table(spark, sf, "lineitem")
    o = li.select(F.expr("concat('d', l_orderkey % 50)").alias("relative_path"), F.expr("concat('x', l_partkey % 40)").alias("symbol"), F.when(F.col("l_linenumber") == 1, "definition").otherwise("reference").alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return overlays.scip_edges(o).select("source", "target")


@query(f"WITH {IR}, {_SYM}, loc AS (SELECT sha256('file:' || r.path) AS source, sha256(n.pre) AS target, 'Imports' AS relation FROM ir r JOIN sym n ON n.path = r.path AND n.name = r.name WHERE r.kind = 'import' UNION ALL SELECT sha256(c.pre), sha256(n.pre), 'Calls' FROM ir r JOIN sym c ON c.path = r.path AND c.start_byte = r.other_start AND c.end_byte = r.other_end JOIN sym n ON n.path = r.path AND n.name = r.name WHERE r.kind = 'call' UNION ALL SELECT sha256(o.pre), sha256(n.pre), 'Implements' FROM ir r JOIN sym o ON o.path = r.path AND o.name = r.name JOIN sym n ON n.path = r.path AND n.name = r.extra WHERE r.kind = 'impl' UNION ALL SELECT sha256('file:' || path), sha256(pre), 'Contains' FROM sym) SELECT * FROM loc")
def file_graphs(spark: Session, sf: str) -> Rows:
    files = S.files(spark, sf)
    return local.file_graphs(files, _ir(spark, sf)).edges.select("source", "target", "relation")


@query(f"WITH {_ALL} SELECT count(*) AS components, sum(size) AS nodes FROM (WITH RECURSIVE b AS (SELECT source AS a, target AS z FROM fused WHERE relation IN ('Calls', 'Imports') UNION SELECT target, source FROM fused WHERE relation IN ('Calls', 'Imports')), r(node, root) AS (SELECT a, a FROM b UNION SELECT b.z, r.root FROM r JOIN b ON r.node = b.a), m AS (SELECT node, min(root) AS root FROM r GROUP BY node) SELECT root, count(*) AS size FROM m GROUP BY root)")
def module_clusters(spark: Session, sf: str) -> Rows:
    c = community.module_clusters(pipeline.index(S.files(spark, sf)))
    return c.agg(F.count("*").alias("components"), F.sum("size").alias("nodes"))


@query(f"WITH RECURSIVE {_ALL}, start AS (SELECT sha256(pre) AS a FROM sym WHERE path = 'src/rust/m3.rs' AND name = 'main'), walk(node, score, hop) AS (SELECT a, 1.0::DOUBLE, 0 FROM start UNION ALL SELECT f.target, w.score * f.confidence, hop + 1 FROM walk w JOIN fused f ON f.source = w.node WHERE hop < 5), best AS (SELECT node, round(max(score), 6) AS score FROM walk GROUP BY node) SELECT b.node, b.score, coalesce('Symbol L' || i.start_line || ':' || i.end_line, substr(b.node, 1, 8)) AS label FROM best b LEFT JOIN (SELECT sha256('sym:' || path || ':' || syntax_kind || ':' || name) AS a, start_line, end_line FROM ir WHERE kind = 'symbol') i ON i.a = b.node WHERE b.score > 0.01")
def blast_radius(spark: Session, sf: str) -> Rows:
    g = pipeline.index(S.files(spark, sf))
    start = I.address("sym:src/rust/m3.rs:function_item:main")
    best = top_scores(g.impact(g.roots(start)), 50)
    named = best.join(g.nodes.select(F.col("address").alias("node"), I.node_label("kind", "span").alias("label")), "node", "left")
    return named.select("node", F.round("score", 6).alias("score"), F.coalesce("label", F.substring("node", 1, 8)).alias("label"))


# Names, paths and kinds

_KINDS = "(VALUES ('function_item', 'Function'), ('function_declaration', 'Function'), ('function_definition', 'Function'), ('struct_item', 'Type'), ('class_declaration', 'Type'), ('class_definition', 'Type'), ('trait_item', 'Interface'), ('interface_declaration', 'Interface'), ('enum_item', 'Enum'), ('enum_declaration', 'Enum'), ('mod_item', 'Module')) k(syntax, canonical)"


@query(f"WITH {IR} SELECT path, name, coalesce(canonical, CASE extra WHEN 'Import' THEN 'Import' ELSE 'Other' END) AS canonical, sha256('canonical:' || coalesce(canonical, CASE extra WHEN 'Import' THEN 'Import' ELSE 'Other' END) || ':' || name) AS address FROM ir LEFT JOIN {_KINDS} ON syntax = syntax_kind WHERE kind = 'symbol'")
def canonical_kinds(spark: Session, sf: str) -> Rows:
    s = pipeline.extract(S.files(spark, sf)).where("kind = 'symbol'")
    k = I.canonical_kind("extra", "syntax_kind")
    return s.select("path", "name", k.alias("canonical"), I.canonical_address(k, F.col("name")).alias("address"))


_PATHS = "paths AS (SELECT p_partkey AS k, './' || split_part(p_type, ' ', 1) || '\\' || CASE p_partkey % 6 WHEN 0 THEN 'target' WHEN 1 THEN '.git' WHEN 2 THEN 'src' WHEN 3 THEN 'venv' ELSE 'lib' END || '/m' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '.py' ELSE '.go' END || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END AS raw FROM part), norm AS (SELECT k, rtrim(replace(substr(raw, 3), '\\', '/'), '/') AS path FROM paths)"


@query(f"WITH {_PATHS} SELECT k, path, CASE split_part(path, '.', -1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript-tsx' WHEN 'py' THEN 'python' END AS lang, k % 6 IN (0, 1, 3) AS excluded, ends_with(path, 'm' || k || '.rs') AS suffix FROM norm")
def path_rules(spark: Session, sf: str) -> Rows:
    p = T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"),
        F.expr("""concat('./', split_part(p_type, ' ', 1), '\\\\', case p_partkey % 6 when 0 then 'target' when 1 then '.git' when 2 then 'src' when 3 then 'venv' else 'lib' end, '/m', p_partkey,
        case p_partkey % 5 when 0 then '.rs' when 1 then '.ts' when 2 then '.tsx' when 3 then '.py' else '.go' end, case when p_partkey % 2 = 0 then '/' else '' end)""").alias("raw"),
    )
    n = p.select("k", I.normalize_path("raw").alias("path"), I.path_matches_suffix("raw", F.concat(F.lit("./m"), F.col("k").cast("string"), F.lit(".rs/"))).alias("suffix"))
    return n.select("k", "path", I.detect_language("path").alias("lang"), I.is_excluded("path").alias("excluded"), "suffix")


@query(f"WITH {S.files_sql()} SELECT lang, count(*) AS files FROM src GROUP BY lang")
def group_by_language(spark: Session, sf: str) -> Rows:
    return S.files(spark, sf).groupBy("lang").agg(F.count("*").alias("files"))


@query("SELECT event_id, event_type || ':' || event_id AS location, event_type AS file, event_id AS line, round(pow(0.9, event_id % 9), 6) AS fades, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 7.5) AS parameter FROM events")
def location_parts(spark: Session, sf: str) -> Rows:
    e = T.table(spark, sf, "events").withColumn("location", F.concat_ws(":", "event_type", "event_id"))
    params = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.col("value"))).otherwise(F.create_map(F.lit("b"), F.col("value")))
    out = e.withColumn("at", I.entrypoint_parts("location"))
    return out.select("event_id", "location", "at.file", "at.line", F.round(C.depth_confidence(F.col("event_id") % 9), 6).alias("fades"), I.param_or(params, "a", 7.5).alias("parameter"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'query' WHEN 2 THEN 'detect_changes' ELSE 'fuse' END AS operation, sha256(sha256(event_type) || sha256(event_id::VARCHAR)) AS chain_hash FROM events")
def evidence_operations(spark: Session, sf: str) -> Rows:
    e = T.table(spark, sf, "events")
    word = F.element_at(F.array(*map(F.lit, ("index", "query", "detect_changes", "fuse", "something else"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", evidence.operation_text(evidence.operation(word)).alias("operation"), chain.content_chain_hash(I.address_of("event_type"), I.address_of(F.col("event_id").cast("string"))).alias("chain_hash"))


# Experiments and workspaces

_RUNS = "runs AS (SELECT event_id AS iteration, user_id AS run, value AS fitness, value / 2 AS stability, CASE WHEN value = 0 THEN 'inconclusive' WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS status FROM events)"


def _runs(spark: Session, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    status = F.when(F.col("value") == 0, "inconclusive").when(F.col("event_type") == "error", "fail").otherwise("pass")
    return e.select(F.col("event_id").alias("iteration"), F.col("user_id").alias("run"), F.col("value").alias("fitness"), (F.col("value") / 2).alias("stability"), status.alias("status"))


@query(f"WITH {_RUNS} SELECT run, iteration, fitness > coalesce(max(fitness) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) AS kept FROM runs")
def hill_climb_replay(spark: Session, sf: str) -> Rows:
    return experiment.kept_log(_runs(spark, sf)).select("run", "iteration", "kept")


@query(
    f"""WITH {_RUNS}, w AS (SELECT fitness > coalesce(max(fitness) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) AS up FROM runs)
    SELECT count(*) AS fitness_count, round(avg(fitness), 6) AS fitness_mean, round(stddev_pop(stability), 6) AS stability_std, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, (SELECT round(avg(CASE WHEN up THEN 1.0::DOUBLE ELSE 0 END), 6) FROM w) AS convergence_rate FROM runs"""
)
def experiment_report(spark: Session, sf: str) -> Rows:
    r = stats.experiment_report(_runs(spark, sf))
    return r.select("fitness_count", F.round("fitness_mean", 6).alias("fitness_mean"), F.round("stability_std", 6).alias("stability_std"), "pass", "fail", F.round("convergence_rate", 6).alias("convergence_rate"))


@query(f"WITH {_RUNS} SELECT iteration, fitness FROM runs ORDER BY iteration DESC LIMIT 20")
def log_tail(spark: Session, sf: str) -> Rows:
    from cairn.sources.logs import tail

    return tail(_runs(spark, sf).select("iteration", "fitness"), experiment.HISTORY, "iteration")


@query(f"WITH RECURSIVE {T.EDGES_SQL}, pick AS (SELECT 'customer:' || c_custkey AS node FROM customer ORDER BY 1 LIMIT 10) SELECT node FROM pick")
def sampled_symbols(spark: Session, sf: str) -> Rows:
    return experiment.sampled_symbols(_customers(spark, sf))


def _customers(spark: Session, sf: str) -> Graph:
    """Customers with a span, below their nations."""
    g = T.graph(spark, sf)
    span = F.struct(*[F.lit(1).cast("bigint").alias(n) for n in ("start_byte", "end_byte", "start_line", "end_line")])
    return Graph(g.nodes.where(F.col("address").startswith("customer:")).withColumn("span", span), g.edges.where("relation in ('Contains', 'Calls', 'Imports')"))


_FITNESS = f"""{T.EDGES_SQL}, kept AS (SELECT * FROM edges WHERE relation IN ('Contains', 'Calls', 'Imports')), pick AS (SELECT 'customer:' || c_custkey AS node FROM customer ORDER BY 1 LIMIT 10)"""


def _reach_sql(factor: float) -> str:
    return f"(root, node, score, hop) AS (SELECT node, node, 1.0::DOUBLE, 0 FROM pick UNION ALL SELECT w.root, e.target, least(1.0, w.score * e.confidence * {factor}), hop + 1 FROM {{0}} w JOIN kept e ON e.source = w.node WHERE hop < 8 AND least(1.0, w.score * e.confidence * {factor}) >= 0.3)"


@query(f"WITH RECURSIVE {_FITNESS}, a{_reach_sql(0.85).format('a')}, b{_reach_sql(0.765).format('b')}, x AS (SELECT root, node, max(score) AS s FROM a GROUP BY root, node), y AS (SELECT root, node, max(score) AS s FROM b GROUP BY root, node) SELECT round(1 - avg(abs(coalesce(x.s, 0) - coalesce(y.s, 0))), 6) AS stability FROM x FULL JOIN y ON x.root = y.root AND x.node = y.node")
def stability(spark: Session, sf: str) -> Rows:
    value = experiment.stability(_customers(spark, sf), experiment.DEFAULTS | {"confidence_threshold": 0.3})
    return spark.createDataFrame([(round(value, 6),)], "stability double")


@query(f"WITH RECURSIVE {_FITNESS}, par AS (SELECT e.source AS parent, e.target AS node FROM kept e JOIN pick p ON p.node = e.target WHERE relation = 'Contains'), pr AS (SELECT p.parent, p.node, s.target AS sibling FROM par p JOIN kept s ON s.source = p.parent AND s.relation = 'Contains' AND s.target <> p.node) SELECT round(avg(0.85), 6) AS accuracy FROM pr")
def impact_accuracy(spark: Session, sf: str) -> Rows:
    value = experiment.impact_accuracy(_customers(spark, sf), experiment.DEFAULTS | {"confidence_threshold": 0.3})
    return spark.createDataFrame([(round(value, 6),)], "accuracy double")


@query("""WITH r AS (SELECT n_nationkey AS ord, 'r' || n_nationkey AS repo FROM nation), e AS (SELECT 'r' || n_nationkey AS a, 'r' || n_regionkey AS b, 'dependency' AS actor FROM nation WHERE n_nationkey <> n_regionkey UNION ALL SELECT 'r' || n_nationkey, 'r' || (n_nationkey - 1), 'shared_address' FROM nation WHERE n_nationkey > 0)
    SELECT actor, count(*) AS edges, (SELECT round(count(*)::DOUBLE / (25 * 24), 6) FROM e) AS coverage FROM e GROUP BY actor""")
def workspace_evidence(spark: Session, sf: str) -> Rows:
    n, edges = T.table(spark, sf, "nation"), _links(spark, sf)
    rate = stats.repository_coverage(n, edges).first().coverage
    return stats.evidence_counts(edges).withColumn("coverage", F.lit(round(rate, 6)))


def _links(spark: Session, sf: str) -> DataFrame:
    n = T.table(spark, sf, "nation")
    repo = lambda e: I.address_of(F.concat(F.lit("r"), F.expr(e).cast("string")))
    one = n.where("n_nationkey <> n_regionkey").select(*edge_columns(repo("n_nationkey"), repo("n_regionkey"), "References", 1.0, provenance(actor="dependency")))
    two = n.where("n_nationkey > 0").select(*edge_columns(repo("n_nationkey"), repo("n_nationkey - 1"), "References", 1.0, provenance(actor="shared_address")))
    return one.unionByName(two)


@query(f"WITH {T.EDGES_SQL} SELECT source, target, relation FROM edges WHERE relation = 'Contains' UNION ALL SELECT source, target, relation FROM edges WHERE relation = 'Calls' UNION ALL SELECT sha256('r' || n_nationkey), sha256('r' || n_regionkey), 'References' FROM nation WHERE n_nationkey <> n_regionkey UNION ALL SELECT sha256('r' || n_nationkey), sha256('r' || (n_nationkey - 1)), 'References' FROM nation WHERE n_nationkey > 0")
def federated_union(spark: Session, sf: str) -> Rows:
    g = T.graph(spark, sf)
    graphs = [Graph(g.nodes, g.edges.where(F.col("relation") == r)) for r in ("Contains", "Calls")]
    return federation.federated(graphs, federation.ordered_links(_links(spark, sf))).edges.select("source", "target", "relation")


@query("SELECT sha256('r' || n_nationkey) AS address, 'Scope' AS kind, 'r' || n_nationkey AS repo FROM nation")
def repository_nodes(spark: Session, sf: str) -> Rows:
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo"))
    return federation.repository_nodes(n).select("address", "kind", "repo")


@query(f"WITH {T.EDGES_SQL}, c AS (SELECT source AS parent, target AS node FROM edges WHERE relation = 'Contains') SELECT parent, node, count(*) OVER (PARTITION BY parent) - 1 AS siblings FROM c")
def sibling_classes(spark: Session, sf: str) -> Rows:
    return resolve.sibling_classes(T.fused_edges(spark, sf))


@query("WITH held AS (SELECT DISTINCT c_nationkey AS repo_ord, 'repo' || c_nationkey AS repo, sha256(c_mktsegment) AS address FROM customer) SELECT address, repo_ord, repo FROM held QUALIFY count(*) OVER (PARTITION BY address) > 1")
def shared_classes(spark: Session, sf: str) -> Rows:
    c = T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("repo_ord"), F.concat(F.lit("repo"), F.col("c_nationkey").cast("string")).alias("repo"), I.address_of("c_mktsegment").alias("address"))
    return federation.shared_classes(c)


@query(f"WITH {_RUNS} SELECT iteration, fitness > coalesce(max(fitness) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) AS improved FROM runs")
def single_log_improvements(spark: Session, sf: str) -> Rows:
    return stats.improvements(_runs(spark, sf)).select("iteration", "improved")


@query("WITH e AS (SELECT event_id AS pos, event_type AS row, substr(sha256(event_type || 'x'), 1, 16) AS chain_hash FROM events) SELECT pos, substr(sha256(row || lag(chain_hash, 1, 'g') OVER (ORDER BY pos)), 1, 16) AS expected FROM e")
def single_log_verify(spark: Session, sf: str) -> Rows:
    e = T.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("row"))
    return chain.verify(e.withColumn("chain_hash", chain.row_hash_column(F.col("row"), F.lit("x"))), "g").select("pos", "expected")
