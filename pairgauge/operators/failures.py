"""Searches in which something fails: the failure is evidence that flows on, not an error that ends the job.

Three tables describe what happened: searches (one per dataset, split and family, with the size of the
smallest training class), encodings (one per search and fold) and fits (one per search, fold and candidate).
A search with too small a class runs nothing. A fold whose encoding fails stops every candidate that is still
alive there. A candidate whose fit fails stops alone. Folds after the stop don't count, even if a table has
them; nothing is replaced. A search with a failed trial has no winner, a pair with a failed side no gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trials as T

INCOMPLETE = "Not every inner fold completed."
NO_WINNER = "Every configured trial must finish every fold."
FITS = "fold, status, balanced_accuracy, roc_auc, fit_seconds, warnings, error"


def _first(condition: Column, value: Column) -> Column:
    """The value of the lowest fold that meets the condition."""
    return F.min(F.when(condition, value))


def trial_evidence(
    searches: DataFrame, encodings: DataFrame, fits: DataFrame, candidates: DataFrame, keys: Sequence[str], inner_folds: int
) -> DataFrame:
    """One row per search and candidate with all that is known of the trial.

    searches: keys, class_rows; encodings: keys, fold, status, error; fits: keys, candidate_order, fold, status,
    balanced_accuracy, roc_auc, fit_seconds, warnings, error; candidates: keys, candidate_order. The result has
    status, error, first_failed_fold (null if no fold failed), completed_folds, fit_seconds over the folds that
    ran, merged warnings, and mean scores where every fold completed.
    """
    keys = list(keys)
    bad = F.col("status") != "success"
    broken = encodings.groupBy(*keys).agg(
        _first(bad, F.struct(F.col("fold").alias("fold"), F.col("error").alias("error"))).alias("encoding")
    )
    per_fold = F.struct(*[F.col(c.strip()) for c in FITS.split(",")])
    gathered = fits.groupBy(*keys, "candidate_order").agg(F.array_sort(F.collect_list(per_fold)).alias("ran"))
    small = T.failure_status(F.col("class_rows"), inner_folds)
    known = (
        candidates.select(*keys, "candidate_order")
        .join(searches.select(*keys, "class_rows"), keys)
        .join(broken, keys, "left")
        .join(gathered, [*keys, "candidate_order"], "left")
        .withColumn("too_small", small)
    )
    none = F.expr("filter(ran, f -> false)")
    before = F.filter("ran", lambda f: F.col("encoding.fold").isNull() | (f["fold"] < F.col("encoding.fold")))
    known = known.withColumn("ran", F.when(F.col("too_small").isNotNull(), none).otherwise(before))
    failed = F.filter("ran", lambda f: f["status"] != "success")
    known = known.withColumn("failed", F.get(failed, F.lit(0)))
    # The fold that failed counts for time and warnings, later ones for nothing.
    upto = F.filter("ran", lambda f: F.col("failed.fold").isNull() | (f["fold"] <= F.col("failed.fold")))
    known = known.withColumn("ran", F.coalesce(upto, F.expr("array()").cast(known.schema["ran"].dataType)))
    good = F.filter("ran", lambda f: f["status"] == "success")
    known = known.withColumn("folds", good).withColumn("completed_folds", F.size("folds"))
    error = F.coalesce(
        F.col("too_small"), F.col("failed.error"), F.when(F.col("too_small").isNull(), F.col("encoding.error")),
        F.when(F.col("completed_folds") < inner_folds, INCOMPLETE),
    )
    stop = F.when(F.col("too_small").isNull(), F.coalesce("failed.fold", "encoding.fold"))
    seconds = F.aggregate("ran", F.lit(0.0), lambda a, f: a + F.coalesce(f["fit_seconds"], F.lit(0.0)))
    warnings = T.merged_warnings(F.transform("ran", lambda f: F.coalesce(f["warnings"], F.expr("array()").cast("array<string>"))))
    done = error.isNull()
    return known.select(
        *keys,
        "candidate_order",
        F.when(done, "success").otherwise("failure").alias("status"),
        error.alias("error"),
        stop.alias("first_failed_fold"),
        "completed_folds",
        seconds.alias("fit_seconds"),
        warnings.alias("convergence_warnings"),
        F.when(done, T.ordered_mean(F.col("folds.balanced_accuracy"), inner_folds)).alias("mean_balanced_accuracy"),
        F.when(done, T.ordered_mean(F.col("folds.roc_auc"), inner_folds)).alias("mean_roc_auc"),
    )


def search_evidence(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per search: winner if every trial finished, else the reason; seconds and warnings of all trials."""
    keys = list(keys)
    chosen = T.select_candidate(trials.withColumn("family", F.lit("")), keys).drop("family")
    first = F.struct("first_failed_fold", "candidate_order", "error")
    warned = F.array_sort(F.collect_list(F.struct("candidate_order", "convergence_warnings")))
    facts = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if(F.col("status") != "success").alias("failed_trials"),
        # Nulls come first, so a search that never began shows its reason.
        F.min(F.when(F.col("status") != "success", first)).alias("first"),
        F.sum("fit_seconds").alias("search_seconds"),
        warned.alias("warned"),
    )
    joined = facts.join(chosen, keys)
    return joined.select(
        *keys,
        "n_trials",
        "failed_trials",
        "all_trials_completed",
        F.when(~F.col("all_trials_completed"), NO_WINNER).alias("error"),
        F.col("first.error").alias("first_error"),
        "search_seconds",
        T.merged_warnings(F.col("warned.convergence_warnings")).alias("convergence_warnings"),
        "selected_candidate_order",
        "inner_balanced_accuracy",
    )


def pair_status(searches: DataFrame, keys: Sequence[str], sides: tuple[str, str]) -> DataFrame:
    """Per dataset and split: whether both sides have a winner, and whose reason it is if not."""
    side = F.col("side")
    per = {s: F.max(F.when(side == s, F.col("all_trials_completed"))) for s in sides}
    reason = {s: F.max(F.when(side == s, F.col("first_error"))) for s in sides}
    score = {s: F.max(F.when(side == s, F.col("inner_balanced_accuracy"))) for s in sides}
    both = F.coalesce(per[sides[0]], F.lit(False)) & F.coalesce(per[sides[1]], F.lit(False))
    return searches.groupBy(*keys).agg(
        both.alias("paired_success"),
        F.when(both, score[sides[1]] - score[sides[0]]).alias("gap"),
        F.coalesce(*[F.when(~F.coalesce(per[s], F.lit(False)), F.concat(F.lit(f"{s}: "), F.coalesce(reason[s], F.lit("no search")))) for s in sides]).alias("reason"),
    )
