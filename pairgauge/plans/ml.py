"""The paired benchmark of one dataset with Spark ML estimators.

Gradient-boosted trees stand for the GBDT family and a multilayer perceptron for the DNN family.
Rows are encoded by ``operators.prep`` from training statistics only, once per fold, and the
encoded fold is shared by all candidates. Parameters Spark ML does not have (l2 regularisation,
alpha, the Adam learning rate) travel with the candidate but do not reach the estimator, and
trees grow level-wise, so scores are not those of other libraries.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import constants as C
from ..frame import LabelledFrame
from ..operators import prep, profile, scoring, splits, trials
from ..protocol import Protocol, candidates
from ..session import ensure_checkpoint_dir

RESULT_SCHEMA = (
    "dataset string, outer_seed int, family string, model string, stage string, "
    "candidate_order int, fold int, status string, balanced_accuracy double, roc_auc double, "
    "n_encoded_features bigint, train_dense_bytes bigint, validation_dense_bytes bigint, "
    "fit_seconds double, error string"
)


@dataclass(frozen=True)
class Effort:
    """Iterations per estimator; smaller values make a trial run."""

    tree_iterations: int = 200
    net_iterations: int = 500
    parallel_fits: int = 4


@dataclass(frozen=True)
class Fit:
    """One row of the work list."""

    outer_seed: int
    family: str
    candidate_order: int
    params: dict
    stage: str
    fold: int | None


def estimator(family: str, params: dict, width: int, seed: int, effort: Effort):
    """Spark ML estimator for a candidate."""
    common = dict(featuresCol="features", labelCol="y", predictionCol="prediction", seed=seed)
    if family == "GBDT":
        return GBTClassifier(
            maxIter=effort.tree_iterations,
            stepSize=params["learning_rate"],
            maxDepth=round(math.log2(params["max_leaf_nodes"] + 1)),
            minInstancesPerNode=params["min_samples_leaf"],
            checkpointInterval=10,
            **common,
        )
    if family == "DNN":
        layers = [width, *params["hidden_layer_sizes"], 2]
        return MultilayerPerceptronClassifier(
            layers=layers, maxIter=effort.net_iterations, **common
        )
    raise ValueError(f"Unknown pipeline family {family!r}.")


def _encoded(
    lf: LabelledFrame, fit_rows: DataFrame, scaled: bool, rows: DataFrame
) -> DataFrame:
    """(y, features, is_fit) of ``rows``, encoded with statistics of ``fit_rows`` only."""
    train = lf.with_df(fit_rows)
    fitted = prep.fit(train)
    return (
        lf.with_df(rows)
        .df.join(fitted, list(lf.keys))
        .select(
            F.col("y").cast("double").alias("y"),
            array_to_vector(prep.feature_values(train, scaled)).alias("features"),
            "is_fit",
        )
    )


def _failure(fit: Fit, dataset: str, reason: str) -> Row:
    return _row(fit, dataset, status="failure", error=reason)


def _row(fit: Fit, dataset: str, **values) -> Row:
    base = dict(
        dataset=dataset, outer_seed=fit.outer_seed, family=fit.family,
        model=C.MODEL_OF_FAMILY[fit.family], stage=fit.stage,
        candidate_order=fit.candidate_order, fold=fit.fold, status="success",
        balanced_accuracy=None, roc_auc=None, n_encoded_features=None, train_dense_bytes=None,
        validation_dense_bytes=None, fit_seconds=None, error=None,
    )
    base.update(values)
    return Row(**base)


def _run_fit(fit: Fit, dataset: str, table: DataFrame, sizes: dict, effort: Effort) -> Row:
    """Fit on the fit rows, score the others. A failing candidate becomes a failure row."""
    try:
        started = time.perf_counter()
        model = estimator(
            fit.family, fit.params, sizes["n_encoded_features"], fit.outer_seed, effort
        ).fit(table.filter("is_fit"))
        seconds = time.perf_counter() - started
        scored = model.transform(table.filter("NOT is_fit")).select(
            F.when(F.col("y").isNotNull(), 1).alias("one"),
            F.col("y").cast("int").alias("y"),
            "prediction",
            vector_to_array("probability")[1].alias("score"),
        )
        row = scoring.prediction_scores(scored, ["one"]).first()
        if row is None or row["status"] != "success":
            return _failure(fit, dataset, "Estimator produced a non-finite score.")
        return _row(
            fit, dataset, fit_seconds=seconds, balanced_accuracy=row["balanced_accuracy"],
            roc_auc=row["roc_auc"], **sizes,
        )
    except Exception as error:  # recorded, not replaced
        return _failure(fit, dataset, f"{type(error).__name__}: {str(error)[:200]}")


def _run_stage(
    lf: LabelledFrame, dataset: str, split: DataFrame, fits: list[Fit], protocol: Protocol,
    effort: Effort,
) -> list[Row]:
    """Encode one fold for one family and run its fits; a failing encoding fails them all."""
    family = fits[0].family
    fit_rows = split.filter("is_fit")
    sized = lf.with_df(fit_rows)
    guard = prep.matrix_guard(prep.encoded_widths(sized), protocol.matrix_limit_bytes).first()
    held_out = split.filter("NOT is_fit").count()
    width = guard["n_encoded_features"]
    sizes = dict(
        n_encoded_features=width,
        train_dense_bytes=guard["dense_bytes"],
        validation_dense_bytes=held_out * width * C.FLOAT_BYTES,
    )
    if max(sizes["train_dense_bytes"], sizes["validation_dense_bytes"]) > (
        protocol.matrix_limit_bytes
    ):
        return [_failure(f, dataset, "Dense matrix above the protocol limit.") for f in fits]
    table = _encoded(lf, fit_rows, scaled=family == "DNN", rows=split).persist()
    try:
        with ThreadPoolExecutor(effort.parallel_fits) as pool:
            return list(
                pool.map(lambda f: _run_fit(f, dataset, table, sizes, effort), fits)
            )
    finally:
        table.unpersist()


def _inner_fits(seed: int, family: str, fold: int, live: Iterable[int], drawn: list) -> list[Fit]:
    return [Fit(seed, family, order, drawn[order], "inner", fold) for order in live]


def run_family(
    lf: LabelledFrame, dataset: str, assigned: DataFrame, seed: int, family: str,
    protocol: Protocol, effort: Effort,
) -> list[Row]:
    """Search and refit of one family on one outer split; plain rows of scores come back."""
    drawn = candidates(family, protocol.candidate_count, protocol.tuning_seed)
    train = assigned.filter((F.col("outer_seed") == seed) & (F.col("part") == "train"))
    rows: list[Row] = []
    live = list(range(len(drawn)))
    for fold in range(protocol.inner_folds):
        if not live:
            break
        split = train.withColumn("is_fit", F.col("fold") != fold)
        fits = _inner_fits(seed, family, fold, live, drawn)
        done = _run_stage(lf, dataset, split, fits, protocol, effort)
        rows += done
        live = [r["candidate_order"] for r in done if r["status"] == "success"]
    if len(live) < len(drawn):
        return rows
    folds: dict[int, list[float]] = {}
    for row in rows:
        folds.setdefault(row["candidate_order"], []).append(row["balanced_accuracy"])
    means = {order: sum(scores) / protocol.inner_folds for order, scores in folds.items()}
    best = min(means, key=lambda order: (-means[order], order))
    whole = assigned.filter(F.col("outer_seed") == seed).withColumn(
        "is_fit", F.col("part") == "train"
    )
    refit = [Fit(seed, family, best, drawn[best], "refit", None)]
    return rows + _run_stage(lf, dataset, whole, refit, protocol, effort)


def run_dataset(
    lf: LabelledFrame, dataset: str, protocol: Protocol, effort: Effort | None = None
) -> DataFrame:
    """All fold and refit scores of both families on one dataset, one row per fit.

    Only scores and sizes reach the driver: their number is set by the protocol, not the data.
    """
    effort = effort or Effort()
    spark = lf.df.sparkSession
    ensure_checkpoint_dir(spark)
    mine = lf.with_df(lf.df.filter(F.col("dataset") == dataset))
    guard = profile.dataset_status(mine, protocol.inner_folds).first()
    if guard is None or guard["status"] != "ok":
        raise ValueError(f"{dataset}: {'unknown' if guard is None else guard['status']}")
    assigned = splits.assign_splits(
        mine, protocol.outer_seeds, protocol.test_size, protocol.inner_folds, carry=lf.features
    ).persist()
    rows: list[Row] = []
    try:
        for seed in protocol.outer_seeds:
            for family in C.FAMILIES:
                rows += run_family(mine, dataset, assigned, seed, family, protocol, effort)
    finally:
        assigned.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def demo(lf: LabelledFrame, dataset: str, seed: int = 42, effort: Effort | None = None) -> DataFrame:
    """Single hold-out of both baseline candidates, without a search."""
    effort = effort or Effort()
    spark = lf.df.sparkSession
    ensure_checkpoint_dir(spark)
    protocol = Protocol("demo", (seed,), 0.25, 2, 1)
    mine = lf.with_df(lf.df.filter(F.col("dataset") == dataset))
    assigned = splits.assign_splits(mine, (seed,), 0.25, 2, carry=lf.features).persist()
    split = assigned.withColumn("is_fit", F.col("part") == "train")
    rows: list[Row] = []
    try:
        for family in C.FAMILIES:
            fit = Fit(seed, family, 0, candidates(family, 1)[0], "refit", None)
            rows += _run_stage(mine, dataset, split, [fit], protocol, effort)
    finally:
        assigned.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def summary(result: DataFrame, protocol: Protocol) -> DataFrame:
    """Outcome of ``run_dataset``: selection, paired scores and gap per dataset and seed."""
    keys = ["dataset", "outer_seed"]
    inner = result.filter("stage = 'inner'")
    chosen = trials.select_candidate(
        trials.trial_means(inner, keys, protocol.inner_folds), keys
    )
    refit = result.filter("stage = 'refit' AND status = 'success'").select(
        *keys, "family", "balanced_accuracy", "roc_auc"
    )
    paired = trials.paired_gap(
        chosen.select(*keys, "family").join(refit, [*keys, "family"], "left"), keys
    )
    return paired
