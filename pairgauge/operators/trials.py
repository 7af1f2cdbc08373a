"""Work list, trial means, candidate selection and pairing of the two pipelines."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..protocol import BASELINE, Protocol, candidates, grid

PARAMS_TYPE = (
    "struct<learning_rate:double,max_leaf_nodes:bigint,l2_regularization:double,"
    "min_samples_leaf:bigint,hidden_layer_sizes:array<bigint>,alpha:double,"
    "learning_rate_init:double>"
)


def _params_row(params: dict) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}


def protocol_table(spark: SparkSession, protocols: Sequence[Protocol]) -> DataFrame:
    schema = (
        "name string, outer_seeds array<bigint>, test_size double, inner_folds bigint, "
        "candidate_count bigint, tuning_seed bigint, matrix_limit_bytes bigint, "
        "recommendation_margin double"
    )
    return spark.createDataFrame([p.as_record() for p in protocols], schema)


def grid_table(spark: SparkSession, family: str) -> DataFrame:
    """The whole search space of a family as rows."""
    rows = [(family, i, _params_row(p)) for i, p in enumerate(grid(family))]
    return spark.createDataFrame(rows, f"family string, grid_order int, params {PARAMS_TYPE}")


def grid_without_baseline(spark: SparkSession, family: str) -> DataFrame:
    """Anti-join of the grid with the baseline candidate."""
    baseline = spark.createDataFrame(
        [(_params_row(BASELINE[family]),)], f"params {PARAMS_TYPE}"
    ).withColumn("text", F.to_json("params"))
    return (
        grid_table(spark, family)
        .withColumn("text", F.to_json("params"))
        .join(baseline.select("text"), "text", "left_anti")
        .drop("text")
    )


def candidate_table(spark: SparkSession, protocol: Protocol) -> DataFrame:
    """(family, model, candidate_order, params, params_json) of a protocol; at most 54 + 27 rows."""
    rows = []
    for family in C.FAMILIES:
        drawn = candidates(family, protocol.candidate_count, protocol.tuning_seed)
        for order, params in enumerate(drawn):
            rows.append(
                (
                    family,
                    C.MODEL_OF_FAMILY[family],
                    order,
                    _params_row(params),
                    json.dumps(_params_row(params), separators=(",", ":")),
                )
            )
    return spark.createDataFrame(
        rows,
        "family string, model string, candidate_order int, "
        f"params {PARAMS_TYPE}, params_json string",
    )


def candidate_array(protocol: Protocol) -> Column:
    """The candidates as one literal array, for explode: their number is fixed by the protocol."""
    entries = []
    for family in C.FAMILIES:
        drawn = candidates(family, protocol.candidate_count, protocol.tuning_seed)
        for order, params in enumerate(drawn):
            entries.append(
                F.struct(
                    F.lit(family).alias("family"),
                    F.lit(C.MODEL_OF_FAMILY[family]).alias("model"),
                    F.lit(order).alias("candidate_order"),
                    F.lit(json.dumps(_params_row(params), separators=(",", ":"))).alias(
                        "params_json"
                    ),
                )
            )
    return F.array(*entries)


def work_list(datasets: DataFrame, key: str, protocol: Protocol) -> DataFrame:
    """One row per fit: dataset x seed x family x candidate x fold.

    The right-hand sides are protocol literals, so each dataset row is exploded in place
    without a shuffle.
    """
    return (
        datasets.select(key)
        .withColumn("outer_seed", F.explode(F.array(*[F.lit(s) for s in protocol.outer_seeds])))
        .withColumn("c", F.explode(candidate_array(protocol)))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(protocol.inner_folds - 1))))
        .select(key, "outer_seed", "c.*", "fold")
    )


def ordered_mean(values: Column, count: int) -> Column:
    """Left-to-right sum of a short double array, then divided: fixes ties exactly."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.lit(count)


def trial_means(trial_folds: DataFrame, keys: Sequence[str], inner_folds: int) -> DataFrame:
    """Mean scores of each candidate from one row per fold (see ``means_of_folds``)."""
    fold = F.struct("fold", "balanced_accuracy", "roc_auc", "status")
    gathered = trial_folds.groupBy(*keys, "family", "candidate_order").agg(
        F.array_sort(F.collect_list(fold)).alias("folds")
    )
    return means_of_folds(gathered, inner_folds)


def means_of_folds(candidates_with_folds: DataFrame, inner_folds: int) -> DataFrame:
    """Adds status, completed folds and mean scores; means need every fold to have succeeded."""
    good = F.filter("folds", lambda f: f["status"] == "success")
    done = F.col("completed_folds") == inner_folds
    return (
        candidates_with_folds.withColumn("completed_folds", F.size(good))
        .withColumn("status", F.when(done, "success").otherwise("failure"))
        .withColumn(
            "mean_balanced_accuracy",
            F.when(done, ordered_mean(F.col("folds.balanced_accuracy"), inner_folds)),
        )
        .withColumn(
            "mean_roc_auc", F.when(done, ordered_mean(F.col("folds.roc_auc"), inner_folds))
        )
        .withColumn("error", F.when(~done, F.lit("Not every inner fold completed.")))
    )


def select_candidate(
    trials: DataFrame, keys: Sequence[str], payload: str | None = None
) -> DataFrame:
    """Winner per search: highest mean balanced accuracy, exact ties to the lowest order.

    A family with any failed trial has no winner. An aggregate, not a window: the state per
    group is a single struct. ``payload`` names a column to return from the winning trial.
    """
    fields = [
        F.col("mean_balanced_accuracy").alias("score"),
        (-F.col("candidate_order")).alias("tie"),
    ]
    if payload is not None:
        fields.append(F.col(payload))
    chosen = trials.groupBy(*keys, "family").agg(
        F.bool_and(F.col("status") == "success").alias("all_trials_completed"),
        F.max(F.struct(*fields)).alias("best"),
    )
    done = F.col("all_trials_completed")
    extra = [] if payload is None else [F.when(done, F.col(f"best.{payload}")).alias(payload)]
    return chosen.select(
        *keys,
        "family",
        "all_trials_completed",
        F.when(done, -F.col("best.tie")).alias("selected_candidate_order"),
        F.when(done, F.col("best.score")).alias("inner_balanced_accuracy"),
        *extra,
    )


def rank_candidates(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full ranking of the candidates of a search; rank 1 is the selected one."""
    order = Window.partitionBy(*keys, "family").orderBy(
        F.col("mean_balanced_accuracy").desc_nulls_last(), "candidate_order"
    )
    return trials.withColumn("candidate_rank", F.row_number().over(order))


def paired_gap(outer_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both families of one split side by side with gap = DNN - GBDT.

    ``outer_scores`` has keys, family, balanced_accuracy, roc_auc; a missing or failed side
    leaves ``paired_success`` false and the gap NULL.
    """
    pivoted = (
        outer_scores.groupBy(*keys)
        .pivot("family", list(C.FAMILIES))
        .agg(
            F.first("balanced_accuracy", ignorenulls=True).alias("ba"),
            F.first("roc_auc", ignorenulls=True).alias("auc"),
        )
    )
    paired = F.col("GBDT_ba").isNotNull() & F.col("DNN_ba").isNotNull()
    return pivoted.select(
        *keys,
        F.col("GBDT_ba").alias("balanced_accuracy_gbdt"),
        F.col("DNN_ba").alias("balanced_accuracy_mlp"),
        F.col("GBDT_auc").alias("roc_auc_gbdt"),
        F.col("DNN_auc").alias("roc_auc_mlp"),
        paired.alias("paired_success"),
        F.when(paired, F.col("DNN_ba") - F.col("GBDT_ba")).alias(C.GAP),
    )


def aggregate_outcome(
    paired: DataFrame, key: Sequence[str], splits: int, margin: float = C.MARGIN
) -> DataFrame:
    """Mean scores over the outer splits, the gap of the means and the winner label.

    All or nothing: a dataset with a failed or missing split has no outcome.
    """
    side = F.struct("outer_seed", "balanced_accuracy_gbdt", "balanced_accuracy_mlp")
    gathered = paired.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("paired_success"), side))).alias("sides")
    )
    done = F.size("sides") == splits
    return (
        gathered.withColumn("primary_success", done)
        .withColumn(
            C.SCORE_GBDT,
            F.when(done, ordered_mean(F.col("sides.balanced_accuracy_gbdt"), splits)),
        )
        .withColumn(
            C.SCORE_DNN,
            F.when(done, ordered_mean(F.col("sides.balanced_accuracy_mlp"), splits)),
        )
        .withColumn(C.GAP, F.col(C.SCORE_DNN) - F.col(C.SCORE_GBDT))
        .withColumn("actual_best_pipeline", winner(F.col(C.GAP)))
        .withColumn("near_tie_within_margin", F.abs(F.col(C.GAP)) <= margin)
        .drop("sides")
    )


def winner(gap: Column) -> Column:
    """DNN only for a positive gap; an exact tie goes to GBDT."""
    return F.when(gap > 0, "DNN").when(gap <= 0, "GBDT")


def recommendation(gap: Column, margin: float = C.MARGIN) -> Column:
    """DNN only where the predicted gap exceeds the margin."""
    return F.when(gap > margin, "DNN").otherwise("GBDT")


def failure_status(class_rows: Column, inner_folds: int) -> Column:
    """Reason every trial of a search fails when the smallest class cannot fill the folds."""
    return F.when(
        class_rows < inner_folds,
        F.format_string(
            "Smallest training class has %d rows; every inner fold needs one.", class_rows
        ),
    )


def merged_warnings(warnings: Column) -> Column:
    """Distinct warnings of a trial's folds in first-seen order."""
    return F.array_distinct(F.flatten(warnings))
