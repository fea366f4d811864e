"""Shards, and threshold-scaled fingerprints."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import sharding, sketches


def sample(seed=1, n=600):
    rng = random.Random(seed)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 300)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "x" * 20_000), (5, rows[5][1])]


def test_shards(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, shard int, slot int").repartition(5)
    got = sharding.assign_shards(df, 8).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(abs(x - sum(loads) / 8) for x in loads) <= max(r.size for r in got)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(df.repartition(2), 8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    assert sharding.assign_shards(df.limit(0)).count() == 0
    assert [r.shard for r in sharding.assign_shards(df.where("doc_id = 1"), 4).collect()] == [2]


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 2)
    records = sharding.sized(spark.createDataFrame([(i, "same text") for i in range(2000)], "doc_id bigint, text string"))
    _, sums, total = sharding.range_totals(spark, records, 4)
    assert total == 2000 * 25 and len(sums) > 16 and max(r.bytes for r in sums) < total / 6


def test_one_row_that_is_there_many_times_is_divided(spark):
    rows = [(7, "one and the same")] * 5000 + [(i, f"other {i}") for i in range(500)] + [(None, "one and the same")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    records = sharding.cut(sharding.sized(df))
    _, sums, total = sharding.range_totals(spark, records, 8)
    assert max(r.n for r in sums) < len(rows) / 10  # the window that orders a range never gets the whole group
    got = sharding.assign_shards(df, 8).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert len(got) == len(rows) and max(loads) - min(loads) <= 64


def test_range_of_equals_a_plain_search():
    rng = np.random.default_rng(2)
    b = np.unique(rng.integers(0, 5, (30, 2)), axis=0)
    k = rng.integers(0, 5, (200, 2))
    assert (sharding.range_of(b, k[:, 0], k[:, 1]) == [sum(tuple(x) <= tuple(y) for x in b) for y in k]).all()


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id bigint, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 5


def plain_sketch(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    runs = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    h = {xxhash.xxh64_intdigest(x.encode(), 42) for x in runs}
    kept = {x for x in h if x < 2**62} or ({min(h)} if h else set())
    return kept, h


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("run_rows", [sketches.RUN_ROWS, 7])
def test_edited_likeness(spark, monkeypatch, run_rows):
    monkeypatch.setattr(sketches, "RUN_ROWS", run_rows)
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice(["é", "wörd", "x", "long" * 5, "a\tb"]) for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "w " * 20_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, sketch string").repartition(4)
    got = {r.doc_id: r for r in sketches.edited_likeness(df).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (a, _), (b, _), (c, _) = map(plain_sketch, (t, edited, after))
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:016x}" for x in sorted(a)) and r.edited_fingerprint == "".join(f"{x:016x}" for x in sorted(b))
        assert r.near_edited == pytest.approx(likeness(a, b)) and r.near_next == pytest.approx(likeness(a, c))


def test_far_and_clustered_ids_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RUN_ROWS", 50)
    ids = [*range(2000), *range(2**40, 2**40 + 500), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id bigint, text string").repartition(4)
    runs = sketches.with_runs(df).groupBy("run").count().collect()
    assert max(r["count"] for r in runs) <= sketches.OVERFULL * 51
    got = {r.doc_id: r for r in sketches.edited_likeness(df).collect()}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        t, after = f"text of {i}", f"text of {order[(k + 1) % len(order)]}"
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    odd = spark.createDataFrame([(3, "a b", 1), (3, "a b", 1), (None, "z", 2), (None, None, 3)], "doc_id bigint, text string, run int")
    rows = sketches.edited_likeness(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None", "None"]
    with pytest.raises(TypeError):
        sketches.edited_likeness(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_sketch_edges_merge_and_containment(spark):
    df = spark.createDataFrame([(1, "only one")], "doc_id bigint, text string")
    r = sketches.edited_likeness(df).first()
    assert r.near_next == 1.0 and sketches.edited_likeness(df.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(2000))
    pair = spark.createDataFrame([(text, " ".join(text.split()[:200]))], "a string, b string")
    both = sketches.with_sketch(sketches.with_sketch(pair, "a", "sa"), "b", "sb")
    got = both.select(sketches.containment(F.col("sb"), F.col("sa")).alias("c"), (F.size(sketches.merge(F.col("sa"), F.col("sb"))) == F.size("sa")).alias("m"), F.size("sa").alias("n")).first()
    assert got.c == 1.0 and got.m and abs(got.n / 1996 - 0.25) < 0.05
    plan = sketches.edited_likeness(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
