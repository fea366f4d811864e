"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written once, and lost executors don't matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that doesn't carry Spark's estimate of its size on.

    What Python or an explode makes of small rows is estimated by the input's size, and a join would send far more than
    estimated through the driver. Without an estimate a join shuffles, and is broadcast only where that proved small.
    """
    session, plan = df.sparkSession, cut(df)._jdf.queryExecution().logical()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.rdd(), plan.schema(), False), session)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A reliable checkpoint and its number of rows, counted in the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]
