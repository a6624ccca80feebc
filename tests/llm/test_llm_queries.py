"""The queries with SQL against it, and all of them for their columns."""

import pytest
from conftest import table

from lexiloom.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_topk": "query_id rank vec_id score",
    "op4_near_dedup": "doc_id n_shingles component_id kept",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_html_text": "page_id url text n_chars",
    "op8_token_file": "doc_id start n_tokens ids_crc32",
    "op9_vector_dedup": "vec_id n_links component_id kept",
    "op10_quality": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert table(df.collect(), df.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(ORACLES)))
def test_columns(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert df.count() >= 50
