"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by the hash of their text, so equal texts lie together, then by the hash of their id, so a hot
text can still be divided.  A size-weighted sample of the keys gives quantile boundaries; the records are
range-partitioned by them and ranges that turn out overfull get boundaries from a sample of their own.  Each range is
then ordered by itself, and prefix sums over the range totals place every record at its exact byte offset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text

SHARDS = 40
#: Least number of ranges for each shard, and the bytes that one range should hold at most.
RANGES_PER_SHARD = 8
RANGE_BYTES = 256 << 20
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 16
#: A range over this many times its even share is subdivided, in so many rounds at most.
OVERFULL = 2.0
ROUNDS = 4
#: Bits of the second key that don't come from id and text, so that equal rows can be divided too.
TIE_BITS = 20


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16; null: 16), text_crc32 (null: that of no bytes, 0) and the two key columns."""
    d = id_text(docs, id_col, text_col)
    return d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64("text").alias("k1"),
        # its low bits part rows that are there many times; fixed by the checkpoint that follows
        F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-(1 << TIE_BITS))).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))).alias("k2"),
    )


def sample_keys(records: DataFrame, total: int, wanted: int, seed: int) -> np.ndarray:
    """Keys drawn with a probability in proportion to size, as rows (k1, k2, weight); about `wanted` of them."""
    p = F.col("size") * F.lit(wanted / max(1, total))
    got = records.where(F.rand(seed) < p).select("k1", "k2", F.greatest(F.col("size"), F.lit(total // max(1, wanted))).alias("w")).collect()
    return np.array([(r.k1, r.k2, r.w) for r in got], dtype=np.int64).reshape(-1, 3)


def quantile_bounds(sample: np.ndarray, ranges: int) -> np.ndarray:
    """ranges - 1 boundaries, at even weights of the ordered sample."""
    s = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    if not len(s) or ranges < 2:
        return np.empty((0, 2), np.int64)
    at = np.searchsorted(np.cumsum(s[:, 2]), s[:, 2].sum() * np.arange(1, ranges) / ranges)
    return np.unique(s[np.minimum(at, len(s) - 1), :2], axis=0)


def range_of(bounds: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Number of boundaries at or below each key."""
    lo, hi = np.searchsorted(bounds[:, 0], k1, "left"), np.searchsorted(bounds[:, 0], k1, "right")
    out = lo.copy()
    for a in np.unique(lo[lo < hi]):  # a boundary inside one text
        m = (lo == a) & (lo < hi)
        out[m] = a + np.searchsorted(bounds[a : hi[m][0], 1], k2[m], "right")
    return out


def ranged(records: DataFrame, bounds: np.ndarray) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast(bounds)  # 16 bytes a range

    @F.pandas_udf("int")
    def rng(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(range_of(shared.value, k1.to_numpy(), k2.to_numpy()).astype(np.int32))

    return records.withColumn("rng", rng("k1", "k2"))


def range_totals(spark: SparkSession, records: DataFrame, n_shards: int) -> tuple[DataFrame, list, int]:
    """The ranged records, (range, bytes, rows) in order, and all bytes."""
    total = records.agg(F.sum("size").alias("t")).first().t or 0
    ranges = max(RANGES_PER_SHARD * n_shards, -(-total // RANGE_BYTES))
    bounds = quantile_bounds(sample_keys(records, total, ranges * SAMPLES_PER_RANGE, 7), ranges)
    for i in range(ROUNDS + 1):
        cutup = ranged(records, bounds)
        sums = cutup.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("rng").collect()
        full = {r.rng: r.bytes for r in sums if r.bytes > OVERFULL * total / ranges and r.n > 1}
        if not full or i == ROUNDS:
            return cutup, sums, total
        inside = sample_keys(cutup.where(F.col("rng").isin(list(full))), sum(full.values()), 4 * SAMPLES_PER_RANGE * sum(-(-b * ranges // total) for b in full.values()), 11 + i)
        which = range_of(bounds, inside[:, 0], inside[:, 1])
        more = [quantile_bounds(inside[which == k], int(-(-b * ranges // total)) + 1) for k, b in full.items()]
        grown = np.unique(np.concatenate([bounds, *more]), axis=0)
        if len(grown) == len(bounds):
            return cutup, sums, total
        bounds = grown


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot (gapless from 0 in its shard), grown_shard (null) per row.

    The shards' sizes differ by about one record at most.  Null and empty texts have size 16; repeated rows each get a
    slot, and are divided like any others; rows with a null id are placed too; very long texts count by their size and
    are not moved; equal texts are neighbours, in one shard unless its end falls among them; an empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    records = cut(sized(docs, id_col, text_col))  # 40 bytes a row: no text is shuffled
    ranges, sums, total = range_totals(spark, records, n_shards)
    before = [(r.rng, int(b), int(n)) for r, b, n in zip(sums, np.cumsum([0, *[r.bytes for r in sums]]), np.cumsum([0, *[r.n for r in sums]]))]
    offsets = spark.createDataFrame(before, "rng int, bytes0 bigint, rows0 bigint")  # a row for each range
    order = Window.partitionBy("rng").orderBy("k1", "k2", F.col("doc_id"))
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranges.select("*", so_far.alias("upto"), F.row_number().over(order).alias("nth")).join(F.broadcast(offsets), "rng")
    middle = 2 * (F.col("bytes0") + F.col("upto")) - F.col("size")  # twice the offset of the record's middle
    placed = placed.withColumn("middle", middle).withColumn("at", F.col("rows0") + F.col("nth") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(least(middle * {n_shards}L div {max(1, 2 * total)}L, {n_shards - 1}) as int)"))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", "at"))
    first = placed.groupBy("shard").agg(F.min("at").alias("at0"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("at0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of `docs` as Parquet, a folder for each shard; returns the assignment.  Ids must be unique and not null."""
    placed = assign_shards(docs, n_shards, id_col, text_col)
    joined = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard"), id_col)
    joined.repartition("shard", F.xxhash64(id_col) % 8).write.partitionBy("shard").parquet(path)
    return placed
