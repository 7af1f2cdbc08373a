"""Failures that flow on as evidence."""

from __future__ import annotations

import pytest

from pairgauge.operators import failures
from pairgauge.plans import attempts, catalogue

from . import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(attempts.SQL))
def test_matches_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    duck = compare.duck(SF)
    sql = catalogue.statements()[name]
    assert compare.spark_rows(df) == compare.duck_rows(duck, sql)
    assert compare.spark_kinds(df) == compare.duck_kinds(duck, sql)


FITS = "dataset string, side string, candidate_order int, fold int, status string, balanced_accuracy double, roc_auc double, fit_seconds double, warnings array<string>, error string"


def _fit(dataset, candidate, fold, score=0.5, seconds=1.0, warnings=(), error=None, side="a"):
    return (dataset, side, candidate, fold, "success" if error is None else "failure", score if error is None else None, score if error is None else None, seconds, list(warnings), error)


@pytest.fixture(scope="module")
def evidence(spark):
    """good: all runs; thin: class too small; wide: encoding fails at fold 1; odd: candidate 1 fails at fold 1."""
    names = ["good", "thin", "wide", "odd", "short"]
    searches = spark.createDataFrame([(d, "a", 1 if d == "thin" else 9) for d in names], "dataset string, side string, class_rows long")
    encodings = spark.createDataFrame(
        [(d, "a", f, "failure" if (d, f) == ("wide", 1) else "success", "too wide" if (d, f) == ("wide", 1) else None) for d in names for f in range(3)],
        "dataset string, side string, fold int, status string, error string",
    )
    fits = [_fit(d, c, f, 0.5 + 0.1 * c + 0.01 * f, 2.0, [f"w{f}", "slow"]) for d in ("good", "thin", "wide") for c in (0, 1) for f in range(3)]
    fits += [_fit("odd", 0, f) for f in range(3)]
    fits += [_fit("odd", 1, 0, seconds=4.0, warnings=["x"]), _fit("odd", 1, 1, seconds=None, warnings=["y", "x"], error="boom"), _fit("odd", 1, 2, seconds=9.0, warnings=["never"])]
    fits += [_fit("short", c, f) for c in (0, 1) for f in range(3 - c)]
    candidates = searches.selectExpr("dataset", "side", "explode(array(0, 1)) AS candidate_order")
    return failures.trial_evidence(searches, encodings, spark.createDataFrame(fits, FITS), candidates, ["dataset", "side"], 3)


def test_trials(evidence):
    got = {(r.dataset, r.candidate_order): r for r in evidence.collect()}
    assert len(got) == 10
    good = got["good", 1]
    assert (good.status, good.error, good.first_failed_fold, good.completed_folds, good.fit_seconds) == ("success", None, None, 3, 6.0)
    assert abs(good.mean_balanced_accuracy - 0.61) < 1e-12 and good.convergence_warnings == ["w0", "slow", "w1", "w2"]
    for c in (0, 1):
        thin = got["thin", c]
        assert thin.error.startswith("Smallest training class has 1 rows")
        assert (thin.completed_folds, thin.fit_seconds, thin.convergence_warnings, thin.first_failed_fold) == (0, 0.0, [], None)
        wide = got["wide", c]
        assert (wide.error, wide.first_failed_fold, wide.completed_folds, wide.fit_seconds) == ("too wide", 1, 1, 2.0)
        assert wide.mean_roc_auc is None
    assert got["odd", 0].status == "success"
    odd = got["odd", 1]
    assert (odd.error, odd.first_failed_fold, odd.completed_folds, odd.fit_seconds) == ("boom", 1, 1, 4.0)
    assert odd.convergence_warnings == ["x", "y"]
    assert (got["short", 1].error, got["short", 1].completed_folds) == (failures.INCOMPLETE, 2)


def test_searches_and_pairs(spark, evidence):
    found = failures.search_evidence(evidence, ["dataset", "side"])
    got = {r.dataset: r for r in found.collect()}
    assert got["good"].all_trials_completed and got["good"].selected_candidate_order == 1 and got["good"].search_seconds == 12.0
    assert got["good"].convergence_warnings == ["w0", "slow", "w1", "w2"]
    odd = got["odd"]
    assert (odd.failed_trials, odd.error, odd.first_error, odd.selected_candidate_order) == (1, failures.NO_WINNER, "boom", None)
    other = found.selectExpr("dataset", "'b' AS side", "n_trials", "failed_trials", "dataset <> 'good' AS all_trials_completed", "error",
                             "first_error", "search_seconds", "convergence_warnings", "selected_candidate_order", "0.7D AS inner_balanced_accuracy")
    pairs = {r.dataset: r for r in failures.pair_status(found.union(other), ["dataset"], ("a", "b")).collect()}
    assert not pairs["good"].paired_success and pairs["good"].reason == "b: no search" and pairs["good"].gap is None
    assert pairs["wide"].reason == "a: too wide"
    alone = {r.dataset: r for r in failures.pair_status(found, ["dataset"], ("a", "b")).collect()}
    assert alone["odd"].reason == "a: boom" and alone["good"].reason == "b: no search"
    both = failures.pair_status(found.union(found.selectExpr("dataset", "'b' AS side", "n_trials", "failed_trials", "all_trials_completed", "error", "first_error", "search_seconds", "convergence_warnings", "selected_candidate_order", "0.75D AS inner_balanced_accuracy")), ["dataset"], ("a", "b"))
    row = both.where("dataset = 'good'").first()
    assert row.paired_success and row.reason is None and abs(row.gap - 0.14) < 1e-12


def test_rows_meet_sums_of_all_candidates_at_once(spark):
    rows = spark.createDataFrame(
        [(f"t{k % 2}", k % 3, k // 3 % 2, "F", str(k % 5), "1", float(k % 7), float(k % 4), None if k % 5 else 1.0) for k in range(60)],
        "dataset string, fold int, y int, linestatus string, band string, month string, quantity double, price double, discount double",
    )
    for made in (attempts._votes(rows), attempts._means(rows)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # Rows and levels are taken apart after the join, above it in the plan.
        assert plan.index("Generate") < plan.index("Join Inner")
    told = attempts._means(rows).groupBy("candidate_order").count().collect()
    assert {r.candidate_order: r["count"] for r in told} == {0: 60, 1: 60, 2: 12}
    votes = attempts._votes(rows).groupBy("candidate_order").agg({"n0": "sum", "n1": "sum"}).collect()
    assert {tuple(r) for r in votes} == {(k, 30, 30) for k in range(3)}
