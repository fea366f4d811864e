"""Watching chained logs and traces as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.confidence import trace_confidence

TRACE = "caller string, callee string, count double, at timestamp"
LOG = "log string, pos bigint, row string, chain_hash string, fitness double"
STATE = "last_pos bigint, last_hash string, best double, idle bigint"
OUT = "log string, pos bigint, ok boolean, best double, idle bigint"


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_calls(trace: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, caller, callee, confidence) of run-time calls in event time; rows later than the watermark are dropped."""
    w = trace.withWatermark("at", late).groupBy(F.window("at", window), "caller", "callee").agg(F.sum("count").alias("n"))
    return w.select("window.start", "caller", "callee", "n", trace_confidence("n").alias("confidence"))


def verified(log: DataFrame, genesis: str) -> DataFrame:
    """Each log row with ok, the best fitness so far and the rows since it rose; the state is one row per log.

    Rows of a micro-batch are taken in the order of pos.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib

        last_pos, last_hash, best, idle = state.get if state.exists else (-1, genesis, None, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values("pos").itertuples():
            ok = hashlib.sha256((r.row + last_hash).encode()).hexdigest()[:16] == r.chain_hash
            idle = 0 if best is None or r.fitness > best else idle + 1
            best = r.fitness if best is None else max(best, r.fitness)
            last_pos, last_hash = int(r.pos), r.chain_hash
            rows.append((key[0], last_pos, ok, best, idle))
        state.update((last_pos, last_hash, best, idle))
        yield pd.DataFrame(rows, columns=["log", "pos", "ok", "best", "idle"])

    return log.groupBy("log").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
