"""The paired nested benchmark of the rule pipelines over all datasets of a frame.

Stages: stratified splits -> rule scores -> trial means -> selection -> outer scores of the
winner -> pairing -> one outcome per dataset; plus descriptors of each outer training part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..frame import LabelledFrame
from ..operators import prep, profile, splits, trials
from ..protocol import Protocol, candidates
from ..session import stored
from . import rules


@dataclass(frozen=True)
class RuleBenchmark:
    """Lazily built stages of one benchmark; every attribute is a DataFrame."""

    frame: LabelledFrame
    protocol: Protocol
    cutoffs: DataFrame
    assigned: DataFrame
    scores: DataFrame

    @property
    def keys(self) -> list[str]:
        return list(self.frame.keys)

    @property
    def split_keys(self) -> list[str]:
        return [*self.keys, "outer_seed"]

    def candidates(self) -> DataFrame:
        """Inner fold scores and refit scores of every candidate."""
        return rules.candidate_scores(self.scores, self.keys, self.protocol)

    def trials(self) -> DataFrame:
        """Status and mean scores of every candidate."""
        return trials.means_of_folds(self.candidates(), self.protocol.inner_folds)

    def selected(self) -> DataFrame:
        """Winner per (dataset, seed, family) with the test scores of its refit.

        The refit scores ride along as payload; only inner means decide.
        """
        chosen = trials.select_candidate(self.trials(), self.split_keys, payload="outer")
        return chosen.select("*", "outer.balanced_accuracy", "outer.roc_auc").drop("outer")

    def outer_scores(self) -> DataFrame:
        """Test scores of each family's winner after the refit."""
        return self.selected()

    def paired(self) -> DataFrame:
        return trials.paired_gap(self.outer_scores(), self.split_keys)

    def outcome(self) -> DataFrame:
        return trials.aggregate_outcome(
            self.paired(),
            self.keys,
            len(self.protocol.outer_seeds),
            self.protocol.recommendation_margin,
        )

    def train_descriptors(self) -> DataFrame:
        """Descriptors of the raw training rows of every outer split."""
        train = self.assigned.filter("part = 'train'")
        lf = self.frame.with_df(train, keys=tuple(self.split_keys))
        return profile.characterize(lf)

    def meta_table(self) -> DataFrame:
        """One row per dataset: mean descriptors over the outer splits and the outcome."""
        means = (
            self.train_descriptors()
            .groupBy(*self.keys)
            .agg(*[F.avg(d).alias(d) for d in C.DESCRIPTORS])
        )
        outcome = self.outcome().filter("primary_success").drop("primary_success")
        return means.join(outcome, self.keys)


def rule_benchmark(
    lf: LabelledFrame, inputs: rules.RuleInputs, protocol: Protocol
) -> RuleBenchmark:
    """Set up the benchmark on datasets that pass its preconditions."""
    eligible = profile.dataset_status(lf, protocol.inner_folds).filter("status = 'ok'")
    frame = lf.with_df(rules.add_cells(lf.df, inputs))
    # One row per class: stored, because every later step assigns rows with it.
    cutoffs = stored(
        splits.block_cutoffs(
            lf, protocol.outer_seeds, protocol.test_size, protocol.inner_folds
        ).join(eligible.select(*lf.keys), list(lf.keys), "left_semi")
    )
    seeds, folds = protocol.outer_seeds, protocol.inner_folds
    # Every row once, next to the others of its class: counts and descriptors of all splits come from here.
    carry = [*lf.features, "band", "bucket"]
    blocks = splits.assign_blocks(frame, cutoffs, seeds, folds, carry=carry)
    blocks = stored(blocks.drop(lf.row_id))
    assigned = splits.per_seed(lf, blocks, seeds, carry=lf.features)
    scores = rules.rule_scores(blocks, lf.keys, seeds, folds)
    return RuleBenchmark(lf, protocol, cutoffs, assigned, scores)


def _params_column(family: str, params: dict) -> Column:
    fields = []
    for name, value in params.items():
        if isinstance(value, tuple):
            literal = F.array(*[F.lit(v).cast("long") for v in value])
        elif isinstance(value, int):
            literal = F.lit(value).cast("long")
        else:
            literal = F.lit(value)
        fields.append(literal.alias(name))
    return F.struct(*fields)


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _family_records(bench: RuleBenchmark, family: str, sized: DataFrame) -> DataFrame:
    """One nested evidence record per (dataset, seed) for one family."""
    protocol, k = bench.protocol, bench.protocol.inner_folds
    drawn = candidates(family, protocol.candidate_count, protocol.tuning_seed)
    literal = F.array(
        *[
            F.struct(
                F.lit(order).cast("long").alias("candidate_order"),
                _params_column(family, params).alias("params"),
                F.lit(rules.resolution(family, params)).alias("cells"),
            )
            for order, params in enumerate(drawn)
        ]
    )
    fold = F.struct(
        F.col("stage").cast("long").alias("fold"), "balanced_accuracy", "roc_auc"
    )
    mine = bench.scores.filter(F.col("family") == family)
    per_rule = (
        mine.groupBy(*bench.split_keys, "cells")
        .agg(F.array_sort(F.collect_list(fold)).alias("stages"))
        .groupBy(*bench.split_keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("cells", "stages"))).alias("by_rule"))
    )

    def trial(c: Column) -> Column:
        folds = F.slice(F.element_at(F.col("by_rule"), c["cells"]), 1, k)
        return F.struct(
            c["candidate_order"].alias("candidate_order"),
            c["params"].alias("params"),
            F.lit("success").alias("status"),
            folds.alias("folds"),
            trials.ordered_mean(folds["balanced_accuracy"], k).alias("mean_balanced_accuracy"),
            trials.ordered_mean(folds["roc_auc"], k).alias("mean_roc_auc"),
            F.lit(0.0).alias("fit_seconds"),
            F.array().cast("array<string>").alias("convergence_warnings"),
            _nothing("string").alias("error"),
        )

    best = F.array_max(
        F.transform(
            F.col("trials"),
            lambda t: F.struct(
                t["mean_balanced_accuracy"].alias("score"), (-t["candidate_order"]).alias("tie")
            ),
        )
    )
    selected = -F.col("best.tie")
    chosen = F.element_at(literal, (selected + 1).cast("int"))
    outer = F.element_at(F.element_at(F.col("by_rule"), F.col("chosen.cells")), k + 1)
    built = (
        per_rule.withColumn("trials", F.transform(literal, trial))
        .withColumn("best", best)
        .withColumn("chosen", chosen)
        .withColumn("outer", outer)
    )
    rows = F.col("train_rows")
    sizes = [
        F.struct(
            F.lit(f).cast("long").alias("fold"),
            F.col("widths")[f].alias("n_encoded_features"),
            ((rows - _fold_rows(rows, f, k)) * F.col("widths")[f] * C.FLOAT_BYTES).alias(
                "train_dense_bytes"
            ),
            (_fold_rows(rows, f, k) * F.col("widths")[f] * C.FLOAT_BYTES).alias(
                "validation_dense_bytes"
            ),
        )
        for f in range(k)
    ]
    record = F.struct(
        F.lit(family).alias("family"),
        F.lit(C.MODEL_OF_FAMILY[family]).alias("model"),
        F.lit(True).alias("all_trials_completed"),
        F.lit(0.0).alias("search_seconds"),
        F.col("trials").alias("trials"),
        F.array(*sizes).alias("preprocessing_folds"),
        selected.alias("selected_candidate_order"),
        F.col("chosen.params").alias("best_params"),
        F.col("best.score").alias("inner_balanced_accuracy"),
        F.struct("outer.balanced_accuracy", "outer.roc_auc").alias("outer_scores"),
        F.lit(0.0).alias("refit_seconds"),
        F.array().cast("array<string>").alias("refit_convergence_warnings"),
        F.struct(
            F.col("widths")[k].alias("n_encoded_features"),
            (rows * F.col("widths")[k] * C.FLOAT_BYTES).alias("train_dense_bytes"),
            (F.col("test_rows") * F.col("widths")[k] * C.FLOAT_BYTES).alias("test_dense_bytes"),
        ).alias("final_preprocessing"),
        _nothing("string").alias("error"),
    )
    return built.join(sized, bench.split_keys).select(
        *bench.split_keys, "train_rows", "test_rows", record.alias(family)
    )


def _fold_rows(rows: Column, fold: int, folds: int) -> Column:
    return F.floor(rows / F.lit(folds)) + (rows % folds > fold).cast("long")


def _split_sizes(bench: RuleBenchmark) -> DataFrame:
    """(keys, outer_seed, train_rows, test_rows, widths): widths of the inner fits, then the refit."""
    counted = bench.cutoffs.groupBy(*bench.keys).agg(
        (F.max("total_rows") - F.max("test_total")).alias("train_rows"),
        F.max("test_total").alias("test_rows"),
    )
    train = bench.frame.with_df(
        bench.assigned.filter("part = 'train'"), keys=tuple(bench.split_keys)
    )
    return prep.fold_widths(train, bench.protocol.inner_folds).join(counted, bench.keys)


def run_artifacts(
    bench: RuleBenchmark, identity: DataFrame, project: str = C.PROJECT
) -> DataFrame:
    """(keys, artifact): the complete nested run record of each dataset as JSON text.

    ``identity`` has one row per dataset: keys, name, openml_id, version, family, clinical.
    """
    protocol, keys = bench.protocol, bench.keys
    split = F.struct(
        F.col("outer_seed").cast("long").alias("outer_seed"),
        F.col("train_rows"),
        F.col("test_rows"),
        F.struct(*C.DESCRIPTORS).alias("meta_features"),
        F.struct(*C.FAMILIES).alias("families"),
        F.lit(True).alias("paired_success"),
        (
            F.col("DNN.outer_scores.balanced_accuracy")
            - F.col("GBDT.outer_scores.balanced_accuracy")
        ).alias(C.GAP),
    )
    bench = replace(bench, scores=stored(bench.scores))
    sized = stored(_split_sizes(bench))
    dnn = _family_records(bench, "DNN", sized).select(*bench.split_keys, "DNN")
    per_split = (
        _family_records(bench, "GBDT", sized)
        .join(dnn, bench.split_keys)
        .join(bench.train_descriptors(), bench.split_keys)
    )
    position = F.array_position(
        F.array(*[F.lit(s) for s in protocol.outer_seeds]), F.col("outer_seed")
    )
    gathered = (
        per_split.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(position.alias("at"), split.alias("s")))).alias("o"))
        .select(*keys, F.col("o.s").alias("outer_splits"))
    )
    n = len(protocol.outer_seeds)

    def mean_of(path) -> Column:
        return trials.ordered_mean(
            F.transform(F.col("outer_splits"), lambda s: path(s).cast("double")), n
        )

    gbdt = mean_of(lambda s: s["families"]["GBDT"]["outer_scores"]["balanced_accuracy"])
    dnn_mean = mean_of(lambda s: s["families"]["DNN"]["outer_scores"]["balanced_accuracy"])
    gap = F.col("mean_dnn") - F.col("mean_gbdt")
    aggregate = F.struct(
        F.col("mean_gbdt").alias(C.SCORE_GBDT),
        F.col("mean_dnn").alias(C.SCORE_DNN),
        gap.alias(C.GAP),
        trials.winner(gap).alias("actual_best_pipeline"),
        (F.abs(gap) <= protocol.recommendation_margin).alias("near_tie_within_margin"),
        F.struct(
            *[
                mean_of(lambda s: s["meta_features"][d]).alias(d)  # noqa: B023
                for d in C.DESCRIPTORS
            ]
        ).alias("meta_features_mean_over_outer_training_partitions"),
    )
    full = protocol.name == "full"
    note = (
        "Rule pipelines stand in for the model families."
        if full
        else "Smoke mode is for development only; rule pipelines stand in for the families."
    )
    record = protocol.as_record()
    seeds = F.array(*[F.lit(s).cast("long") for s in record["outer_seeds"]])
    protocol_struct = F.struct(
        *[
            (
                seeds
                if name == "outer_seeds"
                else F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)
            ).alias(name)
            for name, value in record.items()
        ]
    )
    document = F.struct(
        F.lit(project).alias("project"),
        F.struct("name", "openml_id", "version", "family", "clinical").alias("dataset"),
        protocol_struct.alias("protocol"),
        F.lit(full).alias("research_valid"),
        F.lit("success").alias("status"),
        F.lit(note).alias("status_note"),
        F.col("outer_splits"),
        aggregate.alias("aggregate"),
    )
    return (
        gathered.withColumn("mean_gbdt", gbdt)
        .withColumn("mean_dnn", dnn_mean)
        .join(identity, keys)
        .select(*keys, F.to_json(document, {"ignoreNullFields": "false"}).alias("artifact"))
    )
