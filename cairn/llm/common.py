"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.checkpoint import cut, ensure_checkpoint_dir  # noqa: F401

#: Rows of an Arrow batch sent to Python: keeps a batch of whole texts to a few MB.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size, so that whole texts stay bounded in a worker.

    Plans run after this call returns, so the setting stays.  Spark also ends a batch at the bytes of
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), which bounds batches of very long texts.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))
    return df


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; smaller than a checkpoint, and pruned when read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names that clash with nothing."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at the six ASCII white-space characters; bytes.lower and bytes.split do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (published splitmix64 mixing)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
