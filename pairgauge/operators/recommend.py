"""Predicting the score gap, recommending a pipeline, and judging it by held-out families.

Leave-one-family-out needs no join of every row with every family for models that are functions
of sums: the training sums of a fold are the total minus the family's own.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import stored
from . import meta as M
from . import models, trees
from .scoring import is_finite
from .trials import recommendation, winner

REQUIRED = ("dataset", "family", C.GAP, C.SCORE_GBDT, C.SCORE_DNN)
RIDGE_ALPHA = 1.0
COEFFICIENTS = "family string, intercept double, weights array<double>"
# Relative variance under which a training column counts as constant.
CONSTANT_VARIANCE = 1e-12


def regret(selected: Column) -> Column:
    """Best score minus the selected pipeline's score."""
    gbdt, dnn = F.col(C.SCORE_GBDT), F.col(C.SCORE_DNN)
    return F.greatest(gbdt, dnn) - F.when(selected == "DNN", dnn).otherwise(gbdt)


def _fold_sums(meta: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(family, <name>): each sum over all rows outside the family.

    The totals are one row of a fixed number of values; they enter the plan as literals.
    """
    total = meta.agg(*[F.sum(v).alias(k) for k, v in sums.items()]).first()
    per_family = meta.groupBy("family").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return per_family.select("family", *[(F.lit(total[k]) - F.col(k)).alias(k) for k in sums])


def best_fixed_per_family(meta: DataFrame) -> DataFrame:
    """(family, best_fixed_from_training): better mean score outside the family, tie to GBDT."""
    sums = _fold_sums(
        meta,
        # Decimals add and subtract exactly, so equal scores stay equal.
        {
            name: F.col(score).cast("decimal(24,16)")
            for name, score in (("gbdt", C.SCORE_GBDT), ("dnn", C.SCORE_DNN))
        },
    )
    return sums.select(
        "family",
        F.when(F.col("dnn") > F.col("gbdt"), "DNN").otherwise("GBDT").alias(
            "best_fixed_from_training"
        ),
    )


def dummy_predictions(meta: DataFrame) -> DataFrame:
    """Mean gap of the other families."""
    sums = _fold_sums(meta, {"n": F.lit(1), "gap": F.col(C.GAP)})
    means = sums.select("family", (F.col("gap") / F.col("n")).alias("predicted_gap"))
    return meta.join(means, "family")


def _standardised(meta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and scaled by their global moments, so that later sums do not cancel."""
    facts = []
    for c in columns:
        facts += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    moments = meta.agg(*facts).first()
    return meta.withColumns(
        {
            f"z__{c}": (F.col(c) - F.lit(moments[f"{c}__m"])) / F.lit(moments[f"{c}__s"] or 1.0)
            for c in columns
        }
    )


def _moments(columns: Sequence[str]) -> dict[str, Column]:
    sums = {"n": F.lit(1), "sum_y": F.col(C.GAP)}
    for i, c in enumerate(columns):
        sums[f"x{i}"] = F.col(c)
        sums[f"xy{i}"] = F.col(c) * F.col(C.GAP)
    for (i, a), (j, b) in combinations_with_replacement(list(enumerate(columns)), 2):
        sums[f"xx{i}_{j}"] = F.col(a) * F.col(b)
    return sums


def _solve(width: int, alpha: float):
    """Ridge on standardised columns from moment rows, one fold per row."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, r in batch.iterrows():
                n = float(r["n"])
                mean = np.array([r[f"x{i}"] for i in range(width)]) / n
                second = np.empty((width, width))
                for i in range(width):
                    for j in range(i, width):
                        second[i, j] = second[j, i] = r[f"xx{i}_{j}"] / n
                cov = second - np.outer(mean, mean)
                cross = np.array([r[f"xy{i}"] for i in range(width)]) / n
                cross = cross - mean * (r["sum_y"] / n)
                variance = np.diag(cov).copy()
                live = variance > CONSTANT_VARIANCE
                scale = np.where(live, np.sqrt(np.where(live, variance, 1.0)), 1.0)
                cov = np.where(np.outer(live, live), cov, 0.0) / np.outer(scale, scale)
                cross = np.where(live, cross, 0.0) / scale
                weights = np.linalg.solve(n * cov + alpha * np.eye(width), n * cross) / scale
                rows.append((r["family"], r["sum_y"] / n - weights @ mean, weights.tolist()))
            yield pd.DataFrame(rows, columns=["family", "intercept", "weights"])

    return solve


def ridge_coefficients(
    meta: DataFrame, features: Sequence[str], alpha: float = RIDGE_ALPHA
) -> DataFrame:
    """(family, intercept, weights): the ridge fitted without each family.

    Coefficients refer to globally standardised columns (see ``ridge_predictions``). Training
    columns are standardised per fold (population deviation, constant columns by 1) before the
    penalty applies, and the intercept is not penalised. Only the small p x p solve is Python.
    """
    scaled = _standardised(meta, features)
    sums = _fold_sums(scaled, _moments([f"z__{c}" for c in features]))
    return sums.mapInPandas(_solve(len(features), alpha), COEFFICIENTS)


def ridge_predictions(
    meta: DataFrame, features: Sequence[str] | None = None, alpha: float = RIDGE_ALPHA
) -> DataFrame:
    names = list(features or M.feature_columns(meta))
    scaled = _standardised(meta, names)
    predicted = F.col("intercept")
    for i, c in enumerate(names):
        predicted = predicted + F.col("weights")[i] * F.col(f"z__{c}")
    return scaled.join(ridge_coefficients(meta, names, alpha), "family").select(
        *meta.columns, predicted.alias("predicted_gap")
    )


def tree_predictions(meta: DataFrame, model: str, seed: int = 42) -> DataFrame:
    """Leave-one-family-out predictions of a tree model, all families at once."""
    if model not in trees.SHAPES:
        raise ValueError(f"Unknown tree model {model!r}.")
    names = M.feature_columns(meta)
    shape = dataclasses.replace(trees.SHAPES[model], seed=seed)
    rows = stored(
        meta.select(
            F.lit(trees.ALL).alias("group"), "dataset", F.col("family").alias("fold"),
            F.col(C.GAP).cast("double").alias("y"), *names,
        )
    )
    folds = rows.select("group", "fold").distinct()
    _, predicted = trees.grow(rows, names, shape, folds)
    return meta.join(predicted.select("dataset", F.col("predicted").alias("predicted_gap")), "dataset")


def evaluate(meta: DataFrame, predicted: DataFrame, margin: float = C.MARGIN) -> DataFrame:
    """One row per dataset: predicted and actual gap, recommendation, and regrets.

    A non-finite prediction raises. ``predicted`` is the meta-table plus ``predicted_gap``.
    """
    M.require_columns(meta, REQUIRED)
    gap = F.col("predicted_gap")
    checked = F.when(is_finite(gap), gap).otherwise(
        F.raise_error(F.lit("Recommender produced a non-finite prediction.")).cast("double")
    )
    return (
        predicted.join(best_fixed_per_family(meta), "family")
        .withColumn("predicted_gap", checked)
        .withColumn("recommendation", recommendation(F.col("predicted_gap"), margin))
        .withColumn("oracle", winner(F.col(C.GAP)))
        .select(
            "dataset",
            "family",
            F.col(C.GAP).alias("actual_gap"),
            "predicted_gap",
            "recommendation",
            F.col("oracle").alias("actual_best_pipeline"),
            (F.col("recommendation") == F.col("oracle")).alias("correct_best_pipeline"),
            regret(F.col("recommendation")).alias("regret"),
            regret(F.lit("GBDT")).alias("regret_always_gbdt"),
            regret(F.lit("DNN")).alias("regret_always_dnn"),
            "best_fixed_from_training",
            regret(F.col("best_fixed_from_training")).alias("regret_best_fixed"),
            F.lit(0.0).alias("regret_oracle"),
        )
    )


def summarise(predictions: DataFrame, model: str, margin: float = C.MARGIN) -> DataFrame:
    """One row: accuracy, mean regrets and gap error over all held-out predictions.

    Families are counted by grouping on them first, so no distinct set is held in one task.
    """
    error = F.pow(F.col("predicted_gap") - F.col("actual_gap"), 2)
    partial = predictions.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct_best_pipeline").cast("long")).alias("correct"),
        F.sum("regret").alias("regret"),
        F.sum("regret_always_gbdt").alias("gbdt"),
        F.sum("regret_always_dnn").alias("dnn"),
        F.sum("regret_best_fixed").alias("fixed"),
        F.sum(error).alias("error"),
    )
    n = F.sum("n")
    return partial.agg(
        n.alias("n_datasets"),
        F.count(F.lit(1)).alias("n_families"),
        (F.sum("correct") / n).alias("best_pipeline_accuracy"),
        (F.sum("regret") / n).alias("mean_regret"),
        (F.sum("gbdt") / n).alias("mean_regret_always_gbdt"),
        (F.sum("dnn") / n).alias("mean_regret_always_dnn"),
        (F.sum("fixed") / n).alias("mean_regret_best_fixed"),
        F.sqrt(F.sum("error") / n).alias("rmse_gap"),
    ).select(F.lit(model).alias("model"), F.lit(margin).alias("margin"), "*")


def winner_accuracy(predictions: DataFrame) -> DataFrame:
    """One row: mean absolute gap error, accuracy for each actual winner, and their mean.

    The mean is null where one of the two pipelines never wins.
    """
    actual, right = F.col("actual_best_pipeline"), F.col("correct_best_pipeline").cast("int")
    per = {w: F.avg(F.when(actual == w, right)) for w in C.FAMILIES}
    return predictions.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.avg(F.abs(F.col("predicted_gap") - F.col("actual_gap"))).alias("mae_gap"),
        *[F.count_if(actual == w).alias(f"wins_{w.lower()}") for w in C.FAMILIES],
        *[v.alias(f"accuracy_{w.lower()}") for w, v in per.items()],
        ((per["GBDT"] + per["DNN"]) / 2).alias("balanced_accuracy"),
    )


PREDICTORS = {
    "dummy_mean": dummy_predictions,
    "ridge": ridge_predictions,
    "decision_tree": lambda meta: tree_predictions(meta, "decision_tree"),
    "random_forest": lambda meta: tree_predictions(meta, "random_forest"),
}


def evaluate_recommender(
    meta: DataFrame, model: str = "ridge", margin: float = C.MARGIN
) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions (one row per dataset) and their summary."""
    if model not in PREDICTORS:
        raise ValueError(f"Unknown recommender model {model!r}.")
    M.require_columns(meta, REQUIRED)
    M.guard_training(meta, M.feature_columns(meta), held_out=True)
    predictions = evaluate(meta, PREDICTORS[model](meta), margin)
    return predictions, summarise(predictions, model, margin)


def in_sample(meta: DataFrame, model: str = "ridge", margin: float = C.MARGIN) -> DataFrame:
    """Fit on every row and predict the same rows: a diagnostic, not a performance estimate."""
    features = M.feature_columns(meta)
    M.require_columns(meta, (C.GAP,))
    M.guard_training(meta, features, held_out=False)
    if model == "dummy_mean":
        mean = meta.agg(F.avg(C.GAP)).first()[0]
        fitted = meta.withColumn("predicted_gap", F.lit(mean))
    elif model == "ridge":
        scaled = _standardised(meta, features)
        moments = _moments([f"z__{c}" for c in features])
        row = (
            scaled.agg(*[F.sum(v).alias(k) for k, v in moments.items()])
            .withColumn("family", F.lit("all"))
            .mapInPandas(_solve(len(features), RIDGE_ALPHA), COEFFICIENTS)
            .first()
        )
        predicted = F.lit(row["intercept"])
        for weight, c in zip(row["weights"], features, strict=True):
            predicted = predicted + F.lit(weight) * F.col(f"z__{c}")
        fitted = scaled.select(*meta.columns, predicted.alias("predicted_gap"))
    else:
        fitted = models.predict(models.train(meta, model, features), meta, features, margin=margin)
        fitted = fitted.drop("recommendation")
    return fitted.withColumn(
        "recommendation", recommendation(F.col("predicted_gap"), margin)
    ).withColumn("warning", F.lit("In-sample fit; judge by held-out families instead."))
