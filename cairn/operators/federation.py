"""Workspaces of several repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import address_of, file_address
from cairn.plans.fixpoint import breadth_first, path_to
from cairn.schema import edge_columns, node_columns, provenance

from .graph import Graph


def repository_nodes(repositories: DataFrame) -> DataFrame:
    """Scope nodes of (ord, repo) rows, with the name kept beside the address."""
    return repositories.select(*node_columns(address_of("repo"), "Scope", address_of("repo"), None, provenance(actor="federation")), F.col("repo"))


def dependency_edges(packages: DataFrame) -> DataFrame:
    """(repo, package, deps[]): an edge to each repository whose package is a dependency."""
    wanted = packages.select("repo", F.explode("deps").alias("dep")).distinct()
    have = packages.select(F.col("package").alias("dep"), F.col("repo").alias("other"))
    got = wanted.join(have, "dep").where("repo <> other")
    return got.select(*edge_columns(address_of("repo"), address_of("other"), "References", 1.0, provenance(actor="dependency"), F.array(address_of("repo"), address_of("other"))))


def shared_classes(nodes: DataFrame) -> DataFrame:
    """(address, repo_ord, repo) of addresses that several repositories hold: the classes whose pairs `shared_addresses` lists."""
    held = nodes.select("repo_ord", "repo", "address").distinct()
    several = held.groupBy("address").agg(F.count("*").alias("n")).where("n > 1").select("address")
    return held.join(several, "address").select("address", "repo_ord", "repo")


def shared_addresses(nodes: DataFrame) -> DataFrame:
    """(address, a, b): pairs of repositories, in order, that hold an address, from (repo_ord, repo, address)."""
    held = nodes.select("repo_ord", "repo", "address").distinct()
    x = held.select("address", F.col("repo_ord").alias("i"), F.col("repo").alias("a"))
    y = held.select("address", F.col("repo_ord").alias("j"), F.col("repo").alias("b"))
    return x.join(y, "address").where("i < j").select("address", "a", "b")


def identity_edges(nodes: DataFrame) -> DataFrame:
    shared = shared_addresses(nodes)
    return shared.select(*edge_columns(address_of("a"), address_of("b"), "References", 1.0, provenance(actor="shared_address"), F.array("address")))


def export_table(symbols: DataFrame) -> DataFrame:
    """(repo, lang, name, address), the last file winning."""
    return symbols.groupBy("repo", "lang", "name").agg(F.max_by("address", F.struct("path", "ordinal")).alias("address"))


def cross_repository_imports(imports: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Imports edges from files of a repository to symbols of one it depends on (repo, other)."""
    offered = export_table(symbols).select(F.col("repo").alias("other"), "lang", "name", "address")
    got = imports.join(dependencies.select("repo", "other").distinct(), "repo").join(offered, ["other", "lang", "name"])
    return got.select(*edge_columns(file_address("path"), F.col("address"), "Imports", 0.7, provenance(actor="federation")))


def trace_between(edges: DataFrame, start: str, goal: str, max_depth: int | None = None) -> DataFrame:
    """(hop, source, target) of a shortest path; nothing for the same, unknown or unreachable ends."""
    spark = edges.sparkSession
    steps = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("c")).distinct()
    reached = breadth_first(steps, spark.createDataFrame([(start,)], "node string"), max_depth)
    return spark.createDataFrame(path_to(reached, goal), "hop int, source string, target string")


def trace_depths(edges: DataFrame, repositories: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row (pairs, min, max, mean) of shortest hops between ordered pairs, all starts in one loop."""
    steps = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("c")).distinct()
    found = breadth_first(steps, repositories.select("node"), max_depth).where("hop > 0").join(repositories.select("node"), "node", "left_semi")
    return found.agg(F.count("*").alias("pairs"), F.coalesce(F.min("hop"), F.lit(0)).alias("min_depth"), F.coalesce(F.max("hop"), F.lit(0)).alias("max_depth"), F.coalesce(F.avg("hop"), F.lit(0.0)).alias("mean_depth"))


def ordered_links(edges: DataFrame) -> DataFrame:
    """Edges between repositories in the order they are listed: source, target, relation, actor."""
    return edges.orderBy("source", "target", "relation", F.col("provenance.actor"))


def federated(graphs: list[Graph], links: DataFrame) -> Graph:
    """All repositories' graphs and the edges between them as one graph."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.union(g)
    return Graph(out.nodes, out.edges.unionByName(links, allowMissingColumns=True))
