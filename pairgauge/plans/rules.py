"""Two deterministic count-based pipelines that stand in for the tuned model families.

They let search, selection, refit and pairing run for thousands of datasets in one Spark job,
with results SQL can reproduce. Each is a table of positive rates learned from training rows:

* slot GBDT: rate per equal-width band of one numeric column over its declared domain;
* slot DNN: rate per md5 bucket of a row's remaining features.

A candidate's size parameter sets the resolution (``max_leaf_nodes`` 15/31/63 give 4/8/16 bands,
first hidden layer 32/64/128 gives 8/16/32 buckets); its other parameters are carried, unused.
Real estimators live in ``plans.ml``.

Because a cell's training counts are the total minus the held-out fold, one pass over the rows
yields every inner fit, every refit and every score; the rest works on at most 33 cells a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.scoring import recall_mean
from ..operators.splits import block_column
from ..protocol import Protocol, candidates

FINEST = {"GBDT": 16, "DNN": 32}
RESOLUTIONS = {"GBDT": (4, 8, 16), "DNN": (8, 16, 32)}


@dataclass(frozen=True)
class RuleInputs:
    """Columns the two rules read: one numeric with its domain, and the hashed ones."""

    banded: str
    low: float
    high: float
    hashed: tuple[str, ...]


def resolution(family: str, params: dict) -> int:
    """Number of cells a candidate asks for."""
    if family == "GBDT":
        return (params["max_leaf_nodes"] + 1) // 4
    return params["hidden_layer_sizes"][0] // 4


def add_cells(df: DataFrame, inputs: RuleInputs) -> DataFrame:
    """Finest cell of each rule as two small integers, ``band`` and ``bucket``."""
    bands, buckets = FINEST["GBDT"], FINEST["DNN"]
    share = (F.col(inputs.banded) - F.lit(inputs.low)) / F.lit(inputs.high - inputs.low)
    band = F.least(F.floor(share * bands), F.lit(bands - 1))
    text = F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_LEVEL)) for c in inputs.hashed]
    )
    digest = F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")
    return df.withColumns(
        {
            "band": F.coalesce(F.greatest(band, F.lit(0)), F.lit(-1)).cast("int"),
            "bucket": (digest % buckets).cast("int"),
        }
    )


def _fine_entries() -> Column:
    """The finest cell of either rule."""
    return F.array(
        *[F.struct(F.lit(f).alias("family"), F.col(c).alias("fine")) for f, c in (("GBDT", "band"), ("DNN", "bucket"))]
    )


def _rule_entries() -> Column:
    """The cell a finest one belongs to, at each resolution of its rule."""
    fine = F.col("fine")
    bands = []
    for cells in RESOLUTIONS["GBDT"]:
        step = FINEST["GBDT"] // cells
        coarse = F.when(fine < 0, F.lit(-1)).otherwise(F.floor(fine / F.lit(step)).cast("int"))
        bands.append(_entry(cells, coarse))
    buckets = [_entry(cells, fine % F.lit(cells)) for cells in RESOLUTIONS["DNN"]]
    return F.when(F.col("family") == "GBDT", F.array(*bands)).otherwise(F.array(*buckets))


def _entry(cells: int, cell: Column) -> Column:
    return F.struct(F.lit(cells).alias("cells"), cell.alias("cell"))


def cell_counts(
    blocks: DataFrame, keys: Sequence[str], seeds: Sequence[int], inner_folds: int
) -> DataFrame:
    """(keys, family, cells, cell, n_<seed>_<part>, p_<seed>_<part>): rows and positives per cell.

    Part 0 is the test block, part f + 1 inner fold f. Rows are first counted per finest cell of
    either rule (17 bands, 32 buckets), all seeds at once; the six rules are then sums over that
    table. Its cells of a dataset and family lie together, so no later step exchanges them again.
    """
    counts, names = [], []
    # The cells grow by seeds, stages and resolutions after their exchange, so its parts aren't merged by size.
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for seed in seeds:
        block = F.col(block_column(seed))
        for part in range(inner_folds + 1):
            inside = (block == part).cast("long")
            counts.append(F.sum(inside).alias(f"n_{seed}_{part}"))
            counts.append(F.sum(inside * F.col("y")).alias(f"p_{seed}_{part}"))
            names += [f"n_{seed}_{part}", f"p_{seed}_{part}"]
    return (
        blocks.withColumn("rule", F.explode(_fine_entries()))
        .groupBy(*keys, "rule.family", "rule.fine")
        .agg(*counts)
        .repartition(partitions, *keys, "family")
        .withColumn("rule", F.explode(_rule_entries()))
        .groupBy(*keys, "family", "rule.cells", "rule.cell")
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def _evaluations(seeds: Sequence[int], inner_folds: int) -> Column:
    """Per cell: (seed, stage, fit counts, evaluated counts); stage ``inner_folds`` is the refit."""
    zero = F.lit(0).cast("long")
    entries = []
    for seed in seeds:
        for stage in range(inner_folds + 1):
            fitted = [f + 1 for f in range(inner_folds) if f != stage]
            scored = stage + 1 if stage < inner_folds else 0
            entries.append(
                F.struct(
                    F.lit(seed).alias("outer_seed"),
                    F.lit(stage).alias("stage"),
                    sum((F.col(f"n_{seed}_{f}") for f in fitted), zero).alias("n_fit"),
                    sum((F.col(f"p_{seed}_{f}") for f in fitted), zero).alias("p_fit"),
                    F.col(f"n_{seed}_{scored}").alias("n_eval"),
                    F.col(f"p_{seed}_{scored}").alias("p_eval"),
                )
            )
    return F.array(*entries)


def rule_scores(
    blocks: DataFrame, keys: Sequence[str], seeds: Sequence[int], inner_folds: int
) -> DataFrame:
    """(keys, outer_seed, family, cells, stage, balanced_accuracy, roc_auc, status).

    ``stage`` f < inner_folds validates on fold f, ``stage`` = inner_folds scores the test rows
    of a fit on all training rows. A row is predicted positive where its cell's rate exceeds the
    training rate; a cell unseen in training scores the training rate.
    """
    group = [*keys, "outer_seed", "family", "cells", "stage"]
    whole = Window.partitionBy(*group)
    # One order for all: what scores at least as much is the rest of the group and the cell's ties.
    by_score = whole.orderBy(F.col("score").asc())
    at_most = by_score.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = by_score.rangeBetween(Window.currentRow, Window.currentRow)
    prior = F.col("p_all") / F.col("n_all")
    positives = F.col("p_eval").cast("double")
    negatives = (F.col("n_eval") - F.col("p_eval")).cast("double")
    above = F.col("eval_positives") - F.sum(positives).over(at_most)
    wins = negatives * (above + F.sum(positives).over(ties) + above) / 2
    scored = (
        cell_counts(blocks, keys, seeds, inner_folds)
        .withColumn("e", F.explode(_evaluations(seeds, inner_folds)))
        .select(*keys, "family", "cells", "cell", "e.*")
        .withColumn("n_all", F.sum("n_fit").over(whole))
        .withColumn("p_all", F.sum("p_fit").over(whole))
        .withColumn("eval_positives", F.sum(positives).over(whole))
        .withColumn("score", F.coalesce(F.try_divide("p_fit", "n_fit"), prior))
        .withColumn("positive", F.col("score") > prior)
        .withColumn("wins", wins)
        .groupBy(*group)
        .agg(
            F.sum(negatives).alias("n_negative"),
            F.sum(positives).alias("n_positive"),
            F.sum(F.when(~F.col("positive"), negatives).otherwise(0.0)).alias("hit_negative"),
            F.sum(F.when(F.col("positive"), positives).otherwise(0.0)).alias("hit_positive"),
            F.sum("wins").alias("wins"),
        )
    )
    balanced = recall_mean(
        F.col("n_negative"), F.col("n_positive"), F.col("hit_negative"), F.col("hit_positive")
    )
    auc = F.try_divide(F.col("wins"), F.col("n_negative") * F.col("n_positive"))
    return scored.select(
        *group, balanced.alias("balanced_accuracy"), auc.alias("roc_auc")
    ).withColumn(
        "status",
        F.when(
            F.col("balanced_accuracy").isNotNull() & F.col("roc_auc").isNotNull(), "success"
        ).otherwise("failure"),
    )


def candidate_rules(protocol: Protocol) -> Column:
    """Literal array of (family, candidate_order, cells); its length is fixed by the protocol."""
    entries = []
    for family in C.FAMILIES:
        drawn = candidates(family, protocol.candidate_count, protocol.tuning_seed)
        for order, params in enumerate(drawn):
            entries.append(
                F.struct(
                    F.lit(family).alias("family"),
                    F.lit(order).alias("candidate_order"),
                    F.lit(resolution(family, params)).alias("cells"),
                )
            )
    return F.array(*entries)


def trial_folds(scores: DataFrame, keys: Sequence[str], protocol: Protocol) -> DataFrame:
    """Fold scores of every candidate: each rule score is handed to the candidates using it."""
    return (
        scores.filter(F.col("stage") < protocol.inner_folds)
        .withColumn("candidate_order", F.explode(_users(protocol)))
        .select(
            *keys, "outer_seed", "family", "candidate_order", F.col("stage").alias("fold"),
            "balanced_accuracy", "roc_auc", "status",
        )
    )


def _users(protocol: Protocol) -> Column:
    """Orders of the candidates that use the rule of a row."""
    mine = F.filter(
        candidate_rules(protocol),
        lambda c: (c["family"] == F.col("family")) & (c["cells"] == F.col("cells")),
    )
    return F.transform(mine, lambda c: c["candidate_order"])


def candidate_scores(scores: DataFrame, keys: Sequence[str], protocol: Protocol) -> DataFrame:
    """One row per candidate with its inner ``folds`` and the ``outer`` scores of its refit.

    All stages of a rule are gathered once (inner folds + 1 entries), so search and refit need
    no second look at the cells.
    """
    k = protocol.inner_folds
    stage = F.struct(F.col("stage").alias("fold"), "balanced_accuracy", "roc_auc", "status")
    return (
        scores.groupBy(*keys, "outer_seed", "family", "cells")
        .agg(F.array_sort(F.collect_list(stage)).alias("stages"))
        .withColumn("candidate_order", F.explode(_users(protocol)))
        .select(
            *keys, "outer_seed", "family", "candidate_order",
            F.slice("stages", 1, k).alias("folds"),
            F.element_at("stages", k + 1).alias("outer"),
        )
    )
