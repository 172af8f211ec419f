"""The registered queries without SQL, over the small tables; those with SQL are held against it in tests/test_entry.py."""

import os

import pytest

from tessera.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_license_scans": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


def test_every_query_has_sql_or_stands_here():
    assert set(queries.queries()) == set(COLUMNS) | set(queries.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_over_the_small_tables(spark, name):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = queries.queries()[name](spark, DIR)
    rows = out.collect()
    assert COLUMNS[name] <= set(out.columns)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert name == "op1_packing" or len(rows) == docs.count()
