"""The pipeline on a small table, stage by stage and as a whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["the", "and", "tion", "ing", "ere", "on", "at"]
    make = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))
    item, base = make(30), make(120)
    rows = [(i, make(80), "en", "s", 0) for i in range(30)]
    rows += [(100, base, "en", "s", 0), (101, base.replace(base.split()[5], "changed", 1), "en", "s", 0), (102, base, "en", "s", 0)]
    rows += [(200, make(20) + " " + item + " " + make(20), "en", "s", 0), (201, make(40) + " a.b@mail.example.com +1 (017) 555-7713", "en", "s", 0), (300, "123 456", None, "s", 0), (301, None, None, "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        left.append({r.doc_id for r in docs.collect()})
    clean = set(range(30))
    assert left[0] == clean | {100, 101, 102, 200, 201}
    assert left[1] == clean | {100, 200, 201}
    assert left[2] == left[3] == clean | {100, 201}
    masked = docs.where("doc_id = 201").first().text
    assert "[EMAIL]" in masked and "[PHONE]" in masked and "@" not in masked
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == left[3] and "ids" in out.columns


def test_stages_on_odd_tables(spark, folder):
    """Empty tables, repeated rows, null ids and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    clash = ("same", "hub", "route", "held", "grams", "keys", "size", "root", "lead", "known", "score", "spans", "decoded")
    rows = docs.where("doc_id in (1, 100, 101, 201)").unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = rows.select("*", *[F.lit("x").alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        odd = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(str(r.doc_id) for r in odd.collect()) == ["1", "1", "100", "201", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
