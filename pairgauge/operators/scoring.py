"""Balanced accuracy and exact ROC-AUC over scored rows, grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_totals, value_levels

# The group with the most distinct scores is cut into buckets of about this many.
SCORES_PER_RANK_TASK = 200_000


def is_finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def balanced_accuracy(
    scored: DataFrame, keys: Sequence[str], target: str = "y", prediction: str = "prediction"
) -> DataFrame:
    """Mean recall over the classes that occur; NULL when a prediction is not finite."""
    y, p = F.col(target), F.col(prediction).cast("double")
    counted = scored.groupBy(*keys).agg(
        F.count_if(y == 0).alias("n_negative"),
        F.count_if(y == 1).alias("n_positive"),
        F.count_if((y == 0) & (p == 0)).alias("hit_negative"),
        F.count_if((y == 1) & (p == 1)).alias("hit_positive"),
        F.count_if(~is_finite(p)).alias("bad"),
    )
    value = recall_mean(
        F.col("n_negative"), F.col("n_positive"), F.col("hit_negative"), F.col("hit_positive")
    )
    return counted.select(
        *keys, F.when(F.col("bad") == 0, value).alias("balanced_accuracy")
    )


def recall_mean(
    n_negative: Column, n_positive: Column, hit_negative: Column, hit_positive: Column
) -> Column:
    """Mean of the recalls of the classes present."""
    negative = F.try_divide(hit_negative, n_negative)
    positive = F.try_divide(hit_positive, n_positive)
    classes = (n_negative > 0).cast("int") + (n_positive > 0).cast("int")
    total = F.coalesce(negative, F.lit(0.0)) + F.coalesce(positive, F.lit(0.0))
    return F.try_divide(total, classes)


def score_cells(
    scored: DataFrame, keys: Sequence[str], target: str = "y", score: str = "score"
) -> DataFrame:
    """(keys, score, pos, neg): ties collapse before any ranking."""
    value = F.col(score).cast("double")
    return scored.groupBy(*keys, value.alias("score")).agg(
        F.count_if(F.col(target) == 1).alias("pos"),
        F.count_if(F.col(target) == 0).alias("neg"),
    )


def auc_from_cells(
    cells: DataFrame, keys: Sequence[str], scores_per_task: int = SCORES_PER_RANK_TASK
) -> DataFrame:
    """Exact ROC-AUC from tie-free score cells; NULL for one class or a non-finite score.

    Pairs won by positives, counted as neg x (positives above + half the ties). Where some group has
    more scores than one task should rank, positives above come from running totals over levels of the
    score, so no task ranks a whole large group; the value is the same either way.
    """
    keys = list(keys)
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scores"))
    most = sizes.agg(F.max("n_scores")).first()[0] or 0
    if most <= scores_per_task:
        return _auc_of_buckets(cells.withColumn("bucket", F.lit(0)), keys)
    # A score that isn't finite makes the result null wherever it stands.
    finite = F.when(is_finite(F.col("score")), F.col("score")).otherwise(F.lit(0.0))
    held = cells.withColumn("place", finite)
    placed = running_totals(held, keys, ["pos"], value_levels(F.col("place")), [F.col("place")])
    totals = cells.groupBy(*keys).agg(F.sum("pos").alias("all_pos"))
    above = F.col("all_pos") - F.col("pos__before") - F.col("pos")
    wins = F.col("neg") * (above.cast("double") + F.col("pos") / 2)
    summed = placed.join(totals, keys).groupBy(*keys).agg(
        F.sum(wins).alias("all_wins"),
        F.sum("pos").cast("double").alias("pos"),
        F.sum("neg").cast("double").alias("neg"),
        F.count_if(~is_finite(F.col("score"))).alias("bad"),
    )
    return _auc_of_wins(summed, keys)


def _auc_of_buckets(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    above_inside = (
        Window.partitionBy(*keys, "bucket")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    above_buckets = (
        Window.partitionBy(*keys)
        .orderBy(F.col("bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = neg * (F.coalesce(F.sum(pos).over(above_inside), F.lit(0.0)) + pos / 2)
    per_bucket = (
        bucketed.withColumn("wins", wins)
        .groupBy(*keys, "bucket")
        .agg(
            F.sum("wins").alias("wins"),
            F.sum(pos).alias("pos"),
            F.sum(neg).alias("neg"),
            F.count_if(~is_finite(F.col("score"))).alias("bad"),
        )
    )
    higher = F.coalesce(F.sum("pos").over(above_buckets), F.lit(0.0))
    return _auc_of_wins(
        per_bucket.withColumn("all_wins", F.col("wins") + F.col("neg") * higher)
        .groupBy(*keys)
        .agg(
            F.sum("all_wins").alias("all_wins"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum("bad").alias("bad"),
        ),
        keys,
    )


def _auc_of_wins(summed: DataFrame, keys: list[str]) -> DataFrame:
    share = F.try_divide(F.col("all_wins"), F.col("pos") * F.col("neg"))
    return summed.select(*keys, F.when(F.col("bad") == 0, share).alias("roc_auc"))


def roc_auc(
    scored: DataFrame,
    keys: Sequence[str],
    target: str = "y",
    score: str = "score",
    scores_per_task: int = SCORES_PER_RANK_TASK,
) -> DataFrame:
    """Exact area under the ROC curve of P(class 1); ties count one half."""
    return auc_from_cells(score_cells(scored, keys, target, score), keys, scores_per_task)


def prediction_scores(
    scored: DataFrame, keys: Sequence[str], target: str = "y",
    prediction: str = "prediction", score: str = "score",
) -> DataFrame:
    """Both scores with a status; a non-finite prediction or score is a failure."""
    both = balanced_accuracy(scored, keys, target, prediction).join(
        roc_auc(scored, keys, target, score), list(keys)
    )
    fine = F.col("balanced_accuracy").isNotNull() & F.col("roc_auc").isNotNull()
    return both.withColumn("status", F.when(fine, "success").otherwise("failure"))
