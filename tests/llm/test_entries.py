"""Registered queries: names, columns of the contracts and plans without cross joins or Python where none may be."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from pairgauge.llm import queries
from tests import compare

from .conftest import SF

COLUMNS = {
    "op1_forest": "vec_id n_links component_id kept",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_minhash": "doc_id n_shingles component_id kept",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_substrings": "doc_id start length",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_resampling": "doc_id n_features weight score rank",
    "op12_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_collocations": "lang rank phrase a l r n score",
}


def test_all_are_registered():
    assert set(queries.QUERIES) == {*COLUMNS, "pipeline"}
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_plan(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in ("op2_pii", "op3_order_minhash", "op9_mixing"):
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    with duckdb.connect() as connection:
        for table in ("documents", "embeddings", "benchmark"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        assert compare.spark_rows(df) == compare.duck_rows(connection, queries.ORACLE_SQL[name])
