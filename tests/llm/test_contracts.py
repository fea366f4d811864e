"""Every registered query over the smallest tables: names, kinds and whole results."""

import collections
import hashlib
import os
import zlib

import pytest

from cairn.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

COLUMNS = {
    "op1_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_kneser_ney": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_html": "page_id bigint, text string",
    "op6_decontamination": "doc_id bigint, item_id bigint",
    "op7_suffix": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_sketch": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    out = queries.queries()[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    for column in COLUMNS[name].split(", "):
        assert kinds.get(column.split()[0]) == column.split()[1], column
    got = out.collect()
    table = spark.read.parquet(f"{SF}/{'pages' if name == 'op5_html' else 'documents'}.parquet").collect()
    if name == "op6_decontamination":
        assert {r.doc_id for r in got} <= {r.doc_id for r in table}
        return
    key = "page_id" if name == "op5_html" else "doc_id"
    assert sorted(r[key] for r in got) == sorted(r[key] for r in table)
    text = {r[key]: r["html" if name == "op5_html" else "text"] or "" for r in table}
    for r in got:
        if name in ("op1_langid", "op2_kneser_ney"):
            modulus, rest = (3, 1) if name == "op1_langid" else (10, 0)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        if name == "op2_kneser_ney":
            assert r.n_tokens == len(text[r.doc_id].encode().lower().split()) + 1 and r.n_known <= r.n_tokens and r.score < 0
        if name == "op3_sharding":
            data = text[r.doc_id].encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 40
        if name == "op7_suffix":
            assert r.n_bytes == len(text[r.doc_id].encode()) and 0 <= r.n_removed <= r.n_bytes and len(r.kept_sha256) == 64
        if name == "op9_bpe":
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        if name == "op10_sketch":
            assert r.n_chars == len(text[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if name == "op8_simhash":
            assert len(r.fingerprint) == 16 and r.component_id <= r.doc_id
    if name == "op1_langid":
        truth = {r.doc_id: r.lang for r in table}
        held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]
        assert sum(held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    if name == "op3_sharding":
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())
