from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairgauge.frame import LabelledFrame, infer_roles, normalise
from pairgauge.operators import audit, profile
from pairgauge.sources.tables import labelled


def _frame(spark):
    rows = [
        ("d", 2.5, "oak", "N", 1), ("d", None, None, "N", 1), ("d", 7.5, "elm", "N", 0),
        ("d", 2.5, "oak", "N", 1), ("d", 9.0, "ash", "N", 0),
    ]
    return spark.createDataFrame(rows, "dataset string, girth double, kind string, side string, y int")


def test_descriptors(spark):
    row = profile.characterize(LabelledFrame(_frame(spark), ("girth",), ("kind", "side"))).first()
    found = row.asDict()
    assert {k: found[k] for k in ("dataset", "status", "n_samples", "n_features", "n_classes")} == {
        "dataset": "d", "status": "ok", "n_samples": 5, "n_features": 3, "n_classes": 2,
    }
    shares = {
        "samples_per_feature": 5 / 3, "categorical_fraction": 2 / 3, "missing_fraction": 2 / 15,
        "rows_with_missing_fraction": 1 / 5, "constant_feature_fraction": 1 / 3,
        "minority_class_fraction": 2 / 5, "imbalance_ratio": 3 / 2,
    }
    assert all(math.isclose(found[k], v) for k, v in shares.items())


def test_refused_datasets(spark):
    rows = [
        ("null_target", 1.0, None), ("null_target", 2.0, 1),
        ("one_class", 1.0, 1), ("one_class", 2.0, 1),
        ("infinite", math.inf, 0), ("infinite", 2.0, 1),
        ("small", 1.0, 0), ("small", 2.0, 1),
    ]
    lf = LabelledFrame(spark.createDataFrame(rows, "dataset string, x double, y int"), ("x",), ())
    found = {r["dataset"]: r["status"] for r in profile.characterize(lf).collect()}
    assert found == {
        "null_target": "missing_target", "one_class": "one_class", "infinite": "infinite",
        "small": "ok",
    }
    ready = {r["dataset"]: r["status"] for r in profile.dataset_status(lf, 3).collect()}
    assert ready["small"] == "too_few_rows"
    with pytest.raises(ValueError):
        LabelledFrame(lf.df, (), ())


def test_nan_is_missing_and_missing_only_is_constant(spark):
    rows = [("d", math.nan, None, 7, True, 0), ("d", 2.0, None, 7, False, 1)]
    df = spark.createDataFrame(
        rows, "dataset string, x double, hollow string, flat int, flag boolean, y int"
    )
    numeric, categorical = infer_roles(df, ("dataset", "y"))
    assert (numeric, categorical) == (("x", "flat"), ("hollow", "flag"))
    lf = LabelledFrame(normalise(df, numeric, categorical), numeric, categorical)
    constants = {r["column"] for r in profile.constant_columns(lf).collect()}
    assert constants == {"hollow", "flat"}
    missing = {r["column"]: r["missing"] for r in profile.missing_by_column(lf).collect()}
    assert missing == {"x": 1, "hollow": 2}
    assert {r["flag"] for r in lf.df.collect()} == {"True", "False"}


def test_duplicates_and_conflicts(spark):
    rows = [(4, "p", 1)] * 3 + [(4, "p", 0), (4, "q", 0), (9, "q", 0), (9, "q", 0), (5, "r", 1)]
    df = spark.createDataFrame(rows, "x int, c string, y int").withColumn("dataset", F.lit("d"))
    row = audit.duplicate_audit(LabelledFrame(df, ("x",), ("c",))).first()
    assert row["duplicate_feature_rows"] == 6 and row["duplicate_feature_groups"] == 2
    assert row["exact_duplicate_rows"] == 5 and row["exact_duplicate_groups"] == 2
    assert row["conflicting_target_signature_rows"] == 4
    assert row["conflicting_target_signature_groups"] == 1


def test_missing_cells_keep_signatures_apart(spark):
    rows = [("d", None, "a", 0), ("d", None, "a", 1), ("d", 1.0, None, 0)]
    lf = LabelledFrame(
        spark.createDataFrame(rows, "dataset string, x double, c string, y int"), ("x",), ("c",)
    )
    assert audit.conflicting_rows(lf).count() == 2
    overlap = audit.predictor_overlap(lf.df, lf.df, "y").collect()
    assert [r["shared_signatures"] for r in overlap] == [2, 2]
    assert audit.overlap_counts(lf.df, lf.df, [], "none").first()["shared_signatures"] == 0


def test_labelled_from_raw_table(spark):
    rows = [("n1", 0.5, "x", "late"), ("n2", None, "y", "early"), ("n3", 3.5, None, "late")]
    df = spark.createDataFrame(rows, "node string, delay double, line string, arrival string")
    lf = labelled(df, "arrival", "late", "trains", row_id=("node",))
    assert (lf.numeric, lf.categorical) == (("delay",), ("line",))
    assert [r["y"] for r in lf.df.orderBy("row_id").collect()] == [1, 0, 1]
    summary = profile.load_summary(lf, "late", "early").first()
    assert summary["class_counts"] == {"late": 2, "early": 1}
    with pytest.raises(ValueError, match="does not exist"):
        labelled(df, "departure")


def test_plan_has_no_expand_and_hashes(spark):
    plan = profile.characterize(LabelledFrame(_frame(spark), ("girth",), ("kind", "side")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "SortAggregate" not in text
