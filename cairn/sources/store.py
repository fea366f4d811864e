"""Stored overlays: Parquet, partitioned by overlay, with small metadata beside it, in any store that Spark reaches."""

from __future__ import annotations

import json
import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.graph import Graph
from cairn.schema import EDGES, NODES

FILES = "path string, hash string, length bigint, modified timestamp"
EMBEDDINGS = "address string, vector array<float>, model string, timestamp bigint"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write under another name and rename, so that readers see the old or the new text."""
    fs, p = _file_system(spark, path)
    temporary = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(temporary, True)
    try:
        out.write(json.dumps(value, indent=2, sort_keys=True).encode())
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(temporary, p)


def load_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first().value)


class StoreBackend(Protocol):
    """What the engine needs of a store."""

    def write(self, overlay: str, nodes: DataFrame, edges: DataFrame) -> None: ...

    def append(self, overlay: str, nodes: DataFrame, edges: DataFrame) -> None: ...

    def read(self, overlay: str) -> Graph | None: ...

    def drop(self, overlay: str) -> None: ...

    def overlays(self) -> list[str]: ...


class Store:
    """A folder of overlays.  Writing one replaces it and leaves the others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, overlay: str) -> str:
        return f"{self.folder}/{table}/overlay={overlay}"

    def _exists(self, path: str) -> bool:
        return exists(self.spark, path)

    def write(self, overlay: str, nodes: DataFrame, edges: DataFrame) -> None:
        nodes.select([f.name for f in NODES]).write.mode("overwrite").parquet(self._path("nodes", overlay))
        edges.select([f.name for f in EDGES]).write.mode("overwrite").parquet(self._path("edges", overlay))

    def append(self, overlay: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Add rows; readers of nodes take one row per address."""
        nodes.select([f.name for f in NODES]).write.mode("append").parquet(self._path("nodes", overlay))
        edges.select([f.name for f in EDGES]).write.mode("append").parquet(self._path("edges", overlay))

    def drop(self, overlay: str) -> None:
        for table in ("nodes", "edges"):
            fs, p = _file_system(self.spark, self._path(table, overlay))
            fs.delete(p, True)

    def read(self, overlay: str) -> Graph | None:
        """The overlay's graph, or None if it was never written."""
        if not self._exists(self._path("nodes", overlay)):
            return None
        return Graph(*(self.spark.read.schema(s).parquet(self._path(t, overlay)) for t, s in (("nodes", NODES), ("edges", EDGES))))

    def read_or_empty(self, overlay: str) -> Graph:
        return self.read(overlay) or Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))

    def fused_with_beliefs(self) -> Graph:
        held = self.read_or_empty("beliefs")
        return self.read_or_empty("custom_fused").union(Graph(held.nodes.dropDuplicates(["address"]), held.edges.dropDuplicates(["source", "target", "relation"])))

    def overlays(self) -> list[str]:
        fs, p = _file_system(self.spark, f"{self.folder}/nodes")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName().removeprefix("overlay=") for s in fs.listStatus(p) if s.getPath().getName().startswith("overlay="))

    # Metadata: small text for the counts, a table for the files.

    def save_meta(self, files: DataFrame, graph: Graph) -> dict:
        """Record the indexed files (path, hash, length, modified) and the counts of the graph."""
        files.select("path", "hash", "length", "modified").write.mode("overwrite").parquet(f"{self.folder}/files")
        meta = {"timestamp": int(time.time() * 1000), "file_count": self.indexed_files().count(), "node_count": graph.nodes.count(), "edge_count": graph.edges.count()}
        save_json(self.spark, f"{self.folder}/meta.json", meta)
        return meta

    def load_meta(self) -> dict | None:
        return load_json(self.spark, f"{self.folder}/meta.json")

    def indexed_files(self) -> DataFrame:
        path = f"{self.folder}/files"
        return self.spark.read.schema(FILES).parquet(path) if self._exists(path) else self.spark.createDataFrame([], FILES)

    # Embeddings

    def write_embeddings(self, embeddings: DataFrame) -> None:
        embeddings.select("address", "vector", "model", "timestamp").write.mode("overwrite").parquet(f"{self.folder}/embeddings")

    def read_embeddings(self) -> DataFrame:
        """The stored embeddings; no rows where none were stored."""
        path = f"{self.folder}/embeddings"
        return self.spark.read.schema(EMBEDDINGS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], EMBEDDINGS)


class FileCache:
    """Rows that readers found in each file, keyed by path and content, so that only changed files are read again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/file_cache"

    def rows(self, schema: str) -> DataFrame:
        schema = f"{schema}, file_hash string"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def get(self, files: DataFrame, schema: str) -> DataFrame:
        """Rows of files (path, file_hash) whose content is cached."""
        return self.rows(schema).join(files.select("path", "file_hash"), ["path", "file_hash"], "left_semi")

    def missing(self, files: DataFrame, schema: str) -> DataFrame:
        """Files whose content isn't cached."""
        return files.join(self.rows(schema).select("path", "file_hash").distinct(), ["path", "file_hash"], "left_anti")

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


class StoredOverlay:
    """An overlay that was written to a store, with the level of certainty it was built at."""

    def __init__(self, store: Store, name: str, ground_truth: str = "Available"):
        self.name, self.ground_truth = name, ground_truth
        self._graph = store.read_or_empty(name)

    def nodes(self) -> DataFrame:
        return self._graph.nodes

    def edges(self) -> DataFrame:
        return self._graph.edges


def add_beliefs(store: Store, nodes: DataFrame, edges: DataFrame) -> None:
    """Beliefs are added to earlier ones, never instead of them."""
    store.append("beliefs", nodes, edges)


def counts(store: Store) -> DataFrame:
    """(overlay, nodes, edges) from the partitions' footers."""
    from cairn.operators.stats import overlay_counts

    spark, names = store.spark, store.overlays()
    if not names:
        return spark.createDataFrame([], "overlay string, nodes bigint, edges bigint")
    read = lambda t, s: spark.read.option("basePath", f"{store.folder}/{t}").schema(s).parquet(*[store._path(t, n) for n in names]).withColumn("overlay", F.regexp_extract(F.input_file_name(), "overlay=([^/]+)", 1))
    return overlay_counts(read("nodes", NODES), read("edges", EDGES))
