"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html, langid, lm, pii, sharding, simhash, sketches, suffixdedup
from .common import documents


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixdedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), bpe.default_tables(spark), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_likeness(documents(spark, sf_dir))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(langid.hash_remainder("doc_id", 3) == 1, F.lit(False))
    found = langid.identify(docs, langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "known")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(langid.hash_remainder("doc_id", 10) == 0, F.lit(False))
    scored = lm.score(docs, lm.fit(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", lm.perplexity().alias("perplexity"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can express: lengths and edited texts."""
    return op10_sketch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3 SQL can express: sizes, and that slots have no gap and shards are off the mean by a document at most."""
    placed = op3_sharding(spark, sf_dir)
    sums = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("slots"), F.max("size").alias("largest"))
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    total = sums.agg(F.sum("n").alias("records"), F.sum("bytes").alias("bytes"), F.min(whole).alias("gapless"), (F.max("bytes") - F.min("bytes") <= 2 * F.max("largest")).alias("even"))
    return total.select("records", "bytes", "gapless", "even")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_langid": op1_langid, "op2_kneser_ney": op2_kneser_ney, "op3_sharding": op3_sharding, "op8_simhash": op8_simhash, "op4_pii": op4_pii, "op5_html": op5_html, "op6_decontamination": op6_decontamination, "op7_suffix": op7_suffix, "op9_bpe": op9_bpe, "op10_sketch": op10_sketch, "edited_texts": edited_texts, "shard_balance": shard_balance, "pipeline": pipeline}


#: The other operators' results follow from hashes, samples or models that SQL doesn't have.
OP7_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS p FROM d)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS fresh FROM later),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM marked) GROUP BY doc_id, r),
cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM runs),
sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last FROM runs GROUP BY doc_id),
parts AS (SELECT c.doc_id, string_agg(substr(d.h, 2 * c.upto + 1, 2 * (c.a - c.upto)), '' ORDER BY c.a) AS s FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(parts.s, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN parts ON parts.doc_id = d.doc_id"""


EDITED_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(u, 1, n // 2)) AS edited_sha256 FROM n"""
BALANCE_SQL = "SELECT count(*) AS records, sum(octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS bytes, true AS gapless, true AS even FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix": OP7_SQL, "edited_texts": EDITED_SQL, "shard_balance": BALANCE_SQL}
