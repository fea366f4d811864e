"""Hash-chained logs: each row's hash covers its text and the hash before it."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What the first row of each log is chained to.
GENESIS = {"experiment": "CAIRN_EXPERIMENT_GENESIS", "evidence": "CAIRN_EVIDENCE_GENESIS", "ledger": "CAIRN_GOVERNANCE_GENESIS"}


def genesis_hash(log: str) -> str:
    return hashlib.sha256(GENESIS[log].encode()).hexdigest()[:16]


def row_hash(row: str, previous: str) -> str:
    return hashlib.sha256((row + previous).encode()).hexdigest()[:16]


def row_hash_column(row, previous):
    return F.substring(F.sha2(F.concat(row, previous), 256), 1, 16)


def link(rows: DataFrame, genesis: str, order: str = "pos", row: str = "row", log: str = "log") -> DataFrame:
    """`rows` with pos (from 1, in order) and chain_hash: many logs are chained at once, each by one fold over its rows.

    A chain is serial within its log, so a log has to fit in a task; `ChainWriter` appends to a single long one.
    """
    listed = rows.groupBy(log).agg(F.array_sort(F.collect_list(F.struct(order, row))).alias("rows"))
    start = F.struct(F.lit(genesis).alias("last"), F.array().cast("array<string>").alias("all"))

    def step(held, now):
        h = row_hash_column(now[row], held["last"])
        return F.struct(h.alias("last"), F.concat(held["all"], F.array(h)).alias("all"))

    chained = listed.select(log, "rows", F.aggregate("rows", start, step, lambda held: held["all"]).alias("hashes"))
    each = chained.select(log, F.posexplode(F.arrays_zip("rows", "hashes")).alias("pos", "r"))
    return each.select(log, f"r.rows.{order}", f"r.rows.{row}", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("r.hashes").alias("chain_hash"))


def content_chain_hash(content, previous):
    """Column: the hash that chains a content address to the one before it."""
    return F.sha2(F.concat(content, previous), 256)


#: Positions of a block of a single log; a block is ordered by one task.
BLOCK_ROWS = 100_000


def before(rows: DataFrame, value: str, first: str, order: str = "pos", log: str | None = None) -> DataFrame:
    """`rows` with before: the value of the row before, `first` for the first of a log.

    Logs of many runs are partitioned by `log`.  A single log is cut into blocks of positions, which are ordered by
    themselves; a row for each block carries its last value over to the next one.
    """
    if log:
        return rows.withColumn("before", F.lag(value, 1, first).over(Window.partitionBy(log).orderBy(order)))
    blocked = rows.withColumn("__block", F.floor(F.col(order) / BLOCK_ROWS))
    last = blocked.groupBy("__block").agg(F.max_by(value, order).alias("__last"))
    carried = last.select("__block", F.lag("__last", 1, first).over(Window.orderBy("__block")).alias("__carried"))  # a row a block
    near = blocked.withColumn("before", F.lag(value).over(Window.partitionBy("__block").orderBy(order)))
    return near.join(carried, "__block").withColumn("before", F.coalesce("before", "__carried")).drop("__block", "__carried")


def verify(rows: DataFrame, genesis: str, order: str = "pos", row: str = "row", stored: str = "chain_hash", log: str | None = None) -> DataFrame:
    """Rows with expected and ok.  The stored hashes are inputs, so all rows are checked in parallel; positions are numbers."""
    out = before(rows, stored, genesis, order, log).withColumn("expected", row_hash_column(F.col(row), F.col("before")))
    return out.withColumn("ok", F.col("expected") == F.col(stored)).drop("before")


def first_break(rows: DataFrame, genesis: str, **names: str) -> int | None:
    """Order of the first row that fails, or None.  A log that is cut short can't be told."""
    order = names.get("order", "pos")
    return verify(rows, genesis, **names).where("not ok").agg(F.min(order)).first()[0]


def last_hash(rows: DataFrame, genesis: str, order: str = "pos", stored: str = "chain_hash") -> str:
    return rows.agg(F.max_by(stored, order)).first()[0] or genesis


class ChainWriter:
    """Appends rows to a tab-separated log.  A chain is serial by nature: one writer on the driver."""

    def __init__(self, path: str, log: str, header: list[str]):
        self.path, self.header, self.log = path, header, log
        self.previous = genesis_hash(log)
        if os.path.exists(path) and os.path.getsize(path):
            with open(path, encoding="utf-8") as f:
                rows = [x.rstrip("\n") for x in f if x.strip()][1:]
            if rows:
                self.previous = rows[-1].rsplit("\t", 1)[1]
        else:
            with open(path, "w", encoding="utf-8") as f:
                f.write("\t".join([*header, "chain_hash"]) + "\n")

    def append(self, *values: object) -> str:
        text = "\t".join(f"{v:.6f}" if isinstance(v, float) else str(v) for v in values)
        self.previous = row_hash(text, self.previous)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"{text}\t{self.previous}\n")
            f.flush()
            os.fsync(f.fileno())
        return self.previous
