"""Small configuration files, read on the driver."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Repository:
    name: str
    source_dir: str
    store_dir: str


@dataclass(frozen=True)
class Workspace:
    workspace_id: str
    repositories: tuple[Repository, ...]


def load_workspace(path: str) -> Workspace:
    with open(path, "rb") as f:
        spec = tomllib.load(f)
    return Workspace(spec["workspace_id"], tuple(Repository(r["name"], r["source_dir"], r["store_dir"]) for r in spec.get("repositories", [])))


def package_and_dependencies(root: str) -> tuple[str | None, list[str]]:
    """Package name and dependency keys of a manifest; nothing where there is none."""
    try:
        with open(os.path.join(root, "Cargo.toml"), "rb") as f:
            spec = tomllib.load(f)
    except FileNotFoundError:
        return None, []
    return spec.get("package", {}).get("name"), sorted(spec.get("dependencies", {}))


def packages(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """(ord, repo, package, deps) of the workspace's repositories, in order."""
    rows = [(i, r.name, *package_and_dependencies(r.source_dir)) for i, r in enumerate(workspace.repositories)]
    return spark.createDataFrame(rows, "ord int, repo string, package string, deps array<string>")
