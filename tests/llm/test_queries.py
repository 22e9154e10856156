"""The registered queries over a whole small table: columns, types and one row per document."""

import pytest

from tidemark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_top_k_search": {"query": "bigint", "rank": "int", "doc_id": "bigint", "score": "double"},
    "op7_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    rows = out.collect()
    if name == "op6_top_k_search":
        assert {r["query"] for r in rows} == {i for i in ids if i % 50 == 0} and max(r["rank"] for r in rows) == 10
        assert all(r.doc_id == r["query"] or r["rank"] > 1 or r.score > 0 for r in rows)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(ids)


def test_registry():
    assert set(QUERIES) == set(COLUMNS) | set(ORACLE) and not set(ORACLE) & set(COLUMNS)
