from __future__ import annotations

import numpy as np
import pytest

from pairgauge import constants as C
from pairgauge.operators import meta as M
from pairgauge.operators import recommend
from pairgauge.sources import sinks, tables

SCHEMA = (
    f"dataset string, family string, n_samples double, missing_fraction double, "
    f"n_classes double, {C.SCORE_GBDT} double, {C.SCORE_DNN} double"
)
ROWS = [
    ("elm", "trees", 61.0, 0.41, 2.0, 0.55, 0.59),
    ("oak", "trees", 912.0, 0.02, 2.0, 0.83, 0.77),
    ("bass", "fish", 340.0, 0.17, 2.0, 0.64, 0.66),
    ("pike", "fish", 77.0, 0.0, 2.0, 0.71, 0.58),
    ("wren", "birds", 1500.0, 0.26, 2.0, 0.60, 0.69),
    ("iris", "flowers", 205.0, 0.08, 2.0, 0.92, 0.90),
    ("mint", "herbs", 128.0, 0.33, 2.0, 0.50, 0.50),
]


def _meta(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumn(C.GAP, df[C.SCORE_DNN] - df[C.SCORE_GBDT])


def _ridge_by_hand():
    """Standardise by population deviation, unit penalty, free intercept."""
    x = np.array([r[2:5] for r in ROWS])
    y = np.array([r[6] - r[5] for r in ROWS])
    family = np.array([r[1] for r in ROWS])
    out = {}
    for held in sorted(set(family)):
        train = family != held
        mean, scale = x[train].mean(0), x[train].std(0)
        scale[scale == 0] = 1
        z = (x[train] - mean) / scale
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[train] - y[train].mean()))
        for i in np.where(~train)[0]:
            out[ROWS[i][0]] = y[train].mean() + (x[i] - mean) / scale @ w
    return out


def test_ridge_matches_the_normal_equations(spark):
    found = {r["dataset"]: r["predicted_gap"]
             for r in recommend.ridge_predictions(_meta(spark)).collect()}
    expected = _ridge_by_hand()
    assert found.keys() == expected.keys()
    for name in expected:
        assert abs(found[name] - expected[name]) < 1e-10


def test_evaluation_and_summary(spark):
    predictions, summary = recommend.evaluate_recommender(_meta(spark), "dummy_mean")
    rows = {r["dataset"]: r for r in predictions.collect()}
    assert len(rows) == len(ROWS)
    assert rows["oak"]["regret_always_gbdt"] == 0 and rows["oak"]["regret_always_dnn"] > 0
    gaps = [r[6] - r[5] for r in ROWS if r[1] != "fish"]
    assert abs(rows["pike"]["predicted_gap"] - sum(gaps) / len(gaps)) < 1e-12
    total = summary.first()
    assert (total["n_datasets"], total["n_families"]) == (7, 5)
    assert total["mean_regret"] >= 0


def test_in_sample_models(spark):
    for model in ("dummy_mean", "ridge", "decision_tree"):
        rows = recommend.in_sample(_meta(spark), model).collect()
        assert len(rows) == len(ROWS) and all(r["warning"] for r in rows)


def test_tree_models(spark):
    predictions, _ = recommend.evaluate_recommender(_meta(spark), "decision_tree")
    assert predictions.count() == len(ROWS)


def test_forest_does_not_depend_on_the_layout(spark):
    meta = _meta(spark)
    found = [
        {r["dataset"]: r["predicted_gap"] for r in recommend.tree_predictions(m, "decision_tree").collect()}
        for m in (meta.coalesce(1), meta.repartition(6))
    ]
    assert found[0] == found[1]


def test_best_fixed_breaks_exact_ties_for_trees(spark):
    rows = [
        ("a", "one", 10.0, 0.0, 2.0, 0.1, 0.3), ("b", "one", 10.0, 0.0, 2.0, 0.7, 0.6),
        ("c", "two", 10.0, 0.0, 2.0, 0.2, 0.1), ("d", "huge", 10.0, 0.0, 2.0, 0.9, 0.95),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r[0]: r[1] for r in recommend.best_fixed_per_family(df).collect()}
    # Without "huge" both sum to exactly 1.0, in doubles only up to rounding.
    assert found == {"one": "GBDT", "two": "DNN", "huge": "GBDT"}


def test_guards(spark):
    meta = _meta(spark)
    assert M.feature_columns(meta) == ["n_samples", "missing_fraction", "n_classes"]
    with pytest.raises(ValueError, match="numeric"):
        M.feature_columns(meta.withColumn("n_samples", meta["dataset"]))
    with pytest.raises(ValueError, match="two dataset families"):
        recommend.evaluate_recommender(meta.filter("family = 'trees'"), "dummy_mean")
    with pytest.raises(ValueError, match="missing columns"):
        recommend.evaluate_recommender(meta.drop("family"), "dummy_mean")
    with pytest.raises(ValueError, match="Unknown"):
        recommend.evaluate_recommender(meta, "oracle")


def test_round_trip_and_refusals(spark, tmp_path):
    meta = _meta(spark)
    sinks.write_csv(meta, str(tmp_path / "meta"), "dataset")
    back = tables.read_csv(spark, str(tmp_path / "meta"))
    assert [r["dataset"] for r in back.orderBy("dataset").collect()] == sorted(r[0] for r in ROWS)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(meta, str(tmp_path / "meta"))
    sinks.write_json(meta, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == len(ROWS)
    broken = meta.withColumn("n_samples", meta["n_samples"] * float("inf"))
    with pytest.raises(Exception, match="not finite"):
        sinks.write_json(broken, str(tmp_path / "broken"))
