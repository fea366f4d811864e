"""The engine's operations on a stored index, as Python functions that return plain values."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.extract import pipeline
from cairn.functions.identity import Direction, address, file_address, node_label
from cairn.operators import belief, changes, export, federation, governance, overlays, resolve, stats
from cairn.operators.graph import Graph, Query, top_scores
from cairn.operators import experiment as exp
from cairn.plans.checkpoint import cut, cut_unsized
from cairn.plans.fixpoint import kept
from cairn.sources import config, files, git, logs
from cairn.sources.store import FileCache, Store, add_beliefs, counts, load_json, save_json

TOOLCHAIN = "cairn-1"
FUSED = "custom_fused"


@dataclass
class Run:
    """A background experiment."""

    run_id: str
    log: str
    thread: threading.Thread


@dataclass
class Engine:
    """One source tree and its store.

    `exclude` leaves hidden and build folders out.  Freshness covers every supported language, not only one.
    """

    spark: SparkSession
    source_dir: str
    store_dir: str
    exclude: bool = True
    runs: dict[str, Run] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.store_dir)

    # Building

    def sources(self) -> DataFrame:
        return files.source_files(self.spark, self.source_dir, self.exclude)

    def freshness(self) -> dict:
        """is_fresh, changed, added, removed and last_indexed; a store that was never written is not fresh."""
        meta = self.store.load_meta()
        if meta is None:
            return {"is_fresh": False, "files_changed": 0, "files_added": 0, "files_removed": 0, "last_indexed": 0}
        indexed = self.store.indexed_files()
        r = resolve.freshness(indexed, files.current_hashes(self.sources(), indexed)).first()
        return {"is_fresh": r.is_fresh, "files_changed": r.changed, "files_added": r.added, "files_removed": r.removed, "last_indexed": meta["timestamp"]}

    def index(self, force: bool = False) -> dict:
        """Extract, resolve, fuse and store; nothing is done for a fresh index unless forced."""
        if not force and self.freshness()["is_fresh"]:
            return {"status": "fresh", **(self.store.load_meta() or {})}
        source = self.sources()
        if source.isEmpty():
            raise FileNotFoundError(f"no supported files in {self.source_dir}")
        ir = self.read_rows(source)
        graph = pipeline.fused(source, ir)
        self.store.write(FUSED, graph.nodes, graph.edges)
        for name in pipeline.DERIVED:  # of the index before; `derive` builds them anew
            self.store.drop(name)
        meta = self.store.save_meta(files.file_hashes(source), self.store.read(FUSED))
        return {"status": "indexed", **meta, "failed": [r.asDict() for r in pipeline.failures(ir).orderBy("path").limit(100).collect()]}

    def read_rows(self, source: DataFrame) -> DataFrame:
        """What readers find in the sources; files that were read before come from the parse cache."""
        return cut_unsized(pipeline.extract_cached(source, FileCache(self.spark, self.store_dir)))

    def derive(self) -> list[str]:
        """Store the overlays that follow from the sources' rows, processes and program dependence, if they aren't yet."""
        missing = [name for name in pipeline.DERIVED if name not in self.store.overlays()]
        if missing:
            built = pipeline.derived_overlays(self.read_rows(self.sources()))
            for name in missing:
                self.store.write(name, *built[name])
        return list(pipeline.DERIVED)

    def add_trace(self, path: str) -> int:
        """Store the runtime overlay of a trace; returns its number of edges."""
        symbols = pipeline.symbols(self.read_rows(self.sources()))
        self.store.write("runtime", *overlays.runtime_overlay(logs.read_trace(self.spark, path), symbols))
        return self.store.read("runtime").edges.count()

    def add_scip(self, path: str) -> int:
        """Store the overlay of a symbol dump; returns its number of edges."""
        self.store.write("custom_scip", *overlays.scip_overlay(logs.read_scip(self.spark, path)))
        return self.store.read("custom_scip").edges.count()

    def add_embeddings(self, path: str) -> int:
        self.store.write_embeddings(logs.read_embeddings(self.spark, path))
        return self.store.read_embeddings().count()

    def reindex(self, actor: str) -> dict:
        """Rebuild after the write gate; a stale index is what it is for, so freshness isn't required."""
        governance.check_write(actor, self.freshness()["is_fresh"], 1.0, require_freshness=False)
        return self.index(force=True)

    def status(self) -> dict:
        return {"freshness": self.freshness(), "overlays": [r.asDict() for r in counts(self.store).orderBy("overlay").collect()]}

    def meta(self) -> dict:
        return {"freshness": self.freshness(), "toolchain": TOOLCHAIN}

    # Querying

    def graph(self) -> Graph:
        return self.store.fused_with_beliefs()

    def spans(self, graph: Graph) -> DataFrame:
        """(path, address, start_line, end_line) of the symbols that indexed files contain."""
        paths = self.store.indexed_files().select("path", file_address("path").alias("source"))
        held = graph.edges.where("relation = 'Contains'").join(paths, "source").select("path", F.col("target").alias("address"))
        return held.join(graph.nodes.where("span is not null").select("address", "span.start_line", "span.end_line"), "address")

    def locate(self, graph: Graph, file: str, line: int) -> str:
        """The innermost symbol at a location."""
        spans = cut(self.spans(graph))
        return resolve.find_at(resolve.resolve_file(spans.select("path").distinct(), file), line, spans)

    def context(self, file: str, line: int, depth: int = 1, direction: str = "downstream") -> dict:
        g = self.graph()
        got = g.execute(Query(self.locate(g, file, line), Direction.parse(direction, strict=False), depth))
        shown = got.nodes.select("address", "kind", "confidence", F.col("provenance.source").alias("source"), F.concat_ws(":", "span.start_line", "span.end_line").alias("lines"))
        return {"nodes": [r.asDict() for r in shown.orderBy("address").collect()], "edges": got.edges.count(), "paths": got.paths.count(), "meta": self.meta()}

    def impact(self, file: str, line: int, direction: str = "downstream", top: int = 50) -> dict:
        g = self.graph()
        return {"impact": self._blast(g, g.impact(g.roots(self.locate(g, file, line)), Direction.parse(direction)), top), "meta": self.meta()}

    def _blast(self, g: Graph, scores: DataFrame, top: int) -> list[dict]:
        best = top_scores(scores, top)
        named = best.join(g.nodes.select(F.col("address").alias("node"), F.col("kind"), node_label("kind", "span").alias("label")), "node", "left")
        shown = named.select("node", "score", F.coalesce("kind", F.lit("Unknown")).alias("kind"), F.coalesce("label", F.substring("node", 1, 8)).alias("label"))
        return [r.asDict() for r in shown.orderBy(F.col("score").desc(), "node").collect()]

    def detect_changes(self, from_ref: str = "HEAD", to_ref: str | None = None, same_file: bool = True) -> dict:
        """What a diff touches; hunks only touch nodes of their own file unless `same_file` is off."""
        g = self.graph()
        hunks = git.git_diff(self.spark, self.source_dir, from_ref, to_ref)
        got = changes.detect_changes(g, hunks, self.spans(g).select("address", "path") if same_file else None)
        return {"changed": got.changed.count(), "affected_edges": got.affected_edges.count(), "blast_radius": self._blast(g, got.impact, 50), "stale": got.staleness.where("score > 0.01").count(), "meta": self.meta()}

    def trace(self, entrypoint: str, max_depth: int = 1) -> dict:
        """Calls from file:line, or from where the process of that name starts."""
        g = self.graph()
        file, _, line = entrypoint.rpartition(":")
        if file and line.isdigit():
            starts = [self.locate(g, file, int(line))]
        else:
            self.derive()
            parts = self.store.read_or_empty("process").edges.where((F.col("target") == address(f"process:{entrypoint}")) & (F.col("confidence") == 1.0))
            starts = [r["source"] for r in parts.select("source").distinct().collect()]  # functions of that name
        if not starts:
            raise LookupError(f"no entry point {entrypoint!r}")
        reached = overlays.breadth_first(g.oriented(Direction.DOWNSTREAM, ("Calls",)), g.roots(*starts), max_depth).orderBy("hop", "node")
        return {"chain": [r.asDict() for r in reached.select("node", "hop", "confidence").collect()], "meta": self.meta()}

    def assert_belief(self, claim: str, file: str, line: int, confidence: float, actor: str) -> str:
        """Store a belief about the symbol at a location; earlier beliefs stay."""
        governance.check_write(actor, self.freshness()["is_fresh"], confidence)
        g = self.graph()
        spec = self.spark.createDataFrame([(claim, self.locate(g, file, line), confidence, actor, int(time.time() * 1000), [], [])], "claim string, subject string, confidence double, actor string, timestamp bigint, supports array<string>, contradicts array<string>")
        add_beliefs(self.store, *belief.create_beliefs(spec))
        return address(f"belief:{claim}")

    def visualize(self, path: str, min_confidence: float = 0.0, relations: tuple[str, ...] | None = None) -> str:
        g = self.graph()
        with open(path, "w", encoding="utf-8") as f:
            f.write(export.html_page(export.cytoscape_json(g.nodes, g.edges, min_confidence, relations)))
        return path

    # Experiments

    def experiment(self, log: str, iterations: int, fitness: str = "ImpactAccuracy", model: Callable[[str], str] | None = None) -> exp.Result | None:
        g = self.store.read_or_empty(FUSED)
        with kept(g.nodes) as nodes, kept(g.edges) as edges:
            return exp.run_continuous(Graph(nodes, edges), log, iterations, fitness, model=model)

    def experiment_start(self, log: str, iterations: int) -> str:
        """Run in the background; one at a time."""
        if any(r.thread.is_alive() for r in self.runs.values()):
            raise RuntimeError("an experiment is running")
        run = Run(uuid.uuid4().hex, log, threading.Thread(target=self.experiment, args=(log, iterations), daemon=True))
        self.runs[run.run_id] = run
        run.thread.start()
        return run.run_id

    def experiment_status(self, run_id: str) -> dict:
        run = self.runs[run_id]
        rows = logs.read_log(self.spark, run.log, "experiment", verify=False).agg(F.count("*").alias("n"), F.max("fitness").alias("best")).first()
        return {"running": run.thread.is_alive(), "iterations": rows.n, "best_fitness": rows.best}

    def experiment_results(self, log: str, last_n: int = 1) -> list[dict]:
        kept = logs.read_log(self.spark, log, "experiment", verify=False).select("pos", "iteration", "fitness", "stability", "status", "params_json", "description")
        return [r.asDict() for r in logs.tail(kept, last_n or 10).collect()]

    def verify(self, log: str, kind: str = "experiment") -> int:
        """Rows of a log whose chain holds; raises where it doesn't."""
        return logs.read_log(self.spark, log, kind).count()

    def analyze(self, log: str) -> dict:
        runs = logs.read_log(self.spark, log, "experiment")
        report = stats.experiment_report(runs).first().asDict()
        return report | {"correlations": {r.parameter: r.correlation for r in stats.parameter_correlations(runs).collect()}}


# Workspaces


def federate(spark: SparkSession, config_path: str, store_dir: str) -> dict:
    """Build the workspace of a configuration file: repository nodes, dependencies, shared addresses, symbol imports."""
    ws = config.load_workspace(config_path)
    packages = config.packages(spark, ws)
    nodes = federation.repository_nodes(packages.select("ord", "repo"))
    held = None
    for i, r in enumerate(ws.repositories):
        g = Store(spark, r.store_dir).read_or_empty(FUSED)
        own = g.nodes.select(F.lit(i).alias("repo_ord"), F.lit(r.name).alias("repo"), "address")
        held = own if held is None else held.unionByName(own)
    edges = federation.dependency_edges(packages)
    edges = edges.unionByName(federation.identity_edges(held)) if held is not None else edges
    symbols = imports = None
    for r in ws.repositories:
        ir = pipeline.extract(files.source_files(spark, r.source_dir))
        s = pipeline.symbols(ir).withColumn("repo", F.lit(r.name))
        i = ir.where("kind = 'import'").withColumn("repo", F.lit(r.name))
        symbols, imports = (s, i) if symbols is None else (symbols.unionByName(s), imports.unionByName(i))
    wanted = packages.select("repo", F.explode("deps").alias("dep")).join(packages.select(F.col("package").alias("dep"), F.col("repo").alias("other")), "dep").where("repo <> other")
    edges = edges.unionByName(federation.cross_repository_imports(imports, symbols, wanted)) if symbols is not None else edges
    Store(spark, store_dir).write("custom_federated", nodes, edges)
    save_json(spark, f"{store_dir}/workspace.json", {"workspace_id": ws.workspace_id, "repositories": [r.name for r in ws.repositories]})
    return {"repositories": len(ws.repositories), "edges": Store(spark, store_dir).read("custom_federated").edges.count()}


def federated_graph(spark: SparkSession, config_path: str, store_dir: str) -> Graph:
    """All repositories' stored graphs and the links between them, to be queried as one graph."""
    graphs = [Store(spark, r.store_dir).fused_with_beliefs() for r in config.load_workspace(config_path).repositories]
    links = Store(spark, store_dir).read_or_empty("custom_federated")
    return federation.federated([*graphs, Graph(links.nodes, links.edges.limit(0))], federation.ordered_links(links.edges))


def workspace_context(spark: SparkSession, config_path: str, store_dir: str, target: str, depth: int = 1, direction: str = "downstream") -> dict:
    """What is around an address, across repositories."""
    got = federated_graph(spark, config_path, store_dir).execute(Query(target, Direction.parse(direction, strict=False), depth))
    return {"nodes": [r.asDict() for r in got.nodes.select("address", "kind", "confidence").orderBy("address").collect()], "edges": got.edges.count(), "paths": got.paths.count()}


def workspace_trace(spark: SparkSession, store_dir: str, from_repo: str, to_repo: str) -> list[dict]:
    """Edges of a shortest path between two repositories; nothing for unknown, equal or unreachable ones."""
    g = Store(spark, store_dir).read_or_empty("custom_federated")
    return [r.asDict() for r in federation.trace_between(g.edges, address(from_repo), address(to_repo)).orderBy("hop").collect()]


def workspace_report(spark: SparkSession, store_dir: str) -> dict:
    ws, g = load_json(spark, f"{store_dir}/workspace.json"), Store(spark, store_dir).read_or_empty("custom_federated")
    scopes = g.nodes.where("kind = 'Scope'").select(F.col("address").alias("node"))
    between = g.edges.join(scopes.withColumnRenamed("node", "source"), "source", "left_semi").join(scopes.withColumnRenamed("node", "target"), "target", "left_semi")
    depth = federation.trace_depths(between, scopes).first().asDict()
    return {"workspace": ws, "coverage": stats.repository_coverage(scopes, between).first().coverage, "evidence": {r.actor: r.edges for r in stats.evidence_counts(g.edges).orderBy("actor").collect()}, **depth}
