"""Registered queries against DuckDB on the smallest tables, and plan checks."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module

from . import compare

SF = "/root/testdata/sf0.001"
CHECKED = (
    "load_summary contract_checks characterize_single characterize_grouped constant_columns "
    "dataset_status audit_duplicates conflicting_rows predictor_overlap stratified_kfold "
    "scaler_stats encoded_design matrix_guard roc_auc_exact select_candidate meta_table "
    "recommend_dummy_lofo admission_ledger measured_meta fitted_models recommend_new_mean "
    "recommend_new_ridge recommend_new_ridge_by_region"
).split()


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    sql = entry_module.oracle_sql()[name]
    assert compare.spark_rows(df) == compare.duck_rows(duck, sql)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_entry_and_registration(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
