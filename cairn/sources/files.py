"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.identity import LANGUAGES, detect_language, is_excluded


def source_files(spark: SparkSession, folder: str, exclude: bool = True, extensions: tuple[str, ...] = tuple(LANGUAGES), strip_prefix: bool = True) -> DataFrame:
    """(path, content, lang, length, modified) of all supported files below a folder.

    Hidden and build folders are left out unless `exclude` is off.  Paths are relative to the folder, so an address
    doesn't depend on how the folder was spelled, unless `strip_prefix` is off.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    full = F.regexp_replace("path", "^file:/+", "/")
    prefix = folder.rstrip("/") + "/"
    path = F.when(F.startswith(full, F.lit(prefix)), F.substring(full, F.lit(len(prefix) + 1), F.length(full))).otherwise(full) if strip_prefix else full
    out = read.select(path.alias("path"), "content", "length", F.col("modificationTime").alias("modified")).withColumn("lang", detect_language("path")).where("lang is not null")
    return out.where(~is_excluded("path")) if exclude else out


def source_paths(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("rs",), exclude: bool = True) -> DataFrame:
    """Paths only; the contents are not read."""
    return source_files(spark, folder, exclude, extensions).select("path")


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash, length, modified): 16 hex digits of each content."""
    return files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("hash"), "length", "modified")


def current_hashes(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, hash) of all files; only those whose length or time differs from the indexed ones are read."""
    known = indexed.select("path", F.col("hash").alias("was"), F.col("length").alias("l"), F.col("modified").alias("m"))
    same = files.select("path", "length", "modified").join(known, "path").where("length = l and modified = m").select("path", "was")
    rest = file_hashes(files.join(same.select("path"), "path", "left_anti")).select("path", "hash")
    return same.withColumnRenamed("was", "hash").unionByName(rest)
