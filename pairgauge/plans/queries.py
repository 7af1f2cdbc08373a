"""The registered queries: every operator on the whole driver tables.

Computed doubles are rounded, because engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..frame import LabelledFrame, role_rows
from ..operators import audit, evidence, prep, profile, recommend, scoring, splits, trials
from ..protocol import FULL, SMOKE
from ..session import LONG_ROWS, stored
from ..sources import artifacts, registry
from ..sources.tables import read_table, union_datasets
from . import benchmark, ml, tasks

DIGITS = 6
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
CUTOFF = "1998-07-01"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without negative zero.

    A hair is added first, so that exact halves of the last digit go up in every engine.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + 1e-10, DIGITS) + F.lit(0.0) for c in doubles})


# --- profile and audit ------------------------------------------------------------------


def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = profile.load_summary(tasks.returns(spark, sf), "R", "other")
    return summary.select(
        "dataset",
        "n_rows",
        "n_features",
        "missing_cells",
        F.col("class_counts")["other"].alias("rows_other"),
        F.col("class_counts")["R"].alias("rows_r"),
        F.col("target_encoding")["other"].alias("code_other"),
        F.col("target_encoding")["R"].alias("code_r"),
    )


def characterize_single(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.characterize(tasks.quality(spark, sf)))


def characterize_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors of the five single-table tasks."""
    makers = (tasks.quality, tasks.toxic, tasks.urgent, tasks.purchase, tasks.building)
    return rounded(union_datasets([profile.characterize(m(spark, sf)) for m in makers]))


def characterize_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.characterize(tasks.returns(spark, sf)))


def missing_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_by_column(tasks.returns(spark, sf))


def _with_flat_columns(lf: LabelledFrame) -> LabelledFrame:
    """Adds a constant, an all-missing and a one-value-or-missing column."""
    df = lf.df.withColumns(
        {
            "flat": F.lit(7.0),
            "hollow": F.lit(None).cast("double"),
            "gappy": F.when(F.col("discount").isNotNull(), F.lit(1.0)),
            "home": F.col("family"),
        }
    )
    return LabelledFrame(df, (*lf.numeric, "flat", "hollow", "gappy"), (*lf.categorical, "home"))


def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.constant_columns(_with_flat_columns(tasks.returns(spark, sf)))


def feature_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Role and number of present values of every column of every table."""
    parts = []
    for name in TABLES:
        table = read_table(spark, sf, name)
        present = [F.count(F.col(c)).alias(c) for c in table.columns]
        entries = F.array(
            *[
                F.struct(
                    F.lit(dataset).alias("dataset"),
                    F.lit(position).alias("position"),
                    F.lit(column).alias("column"),
                    F.lit(role).alias("role"),
                    F.col(column).alias("present"),
                )
                for dataset, position, column, role in role_rows(name, table)
            ]
        )
        parts.append(table.agg(*present).select(F.explode(entries).alias("e")).select("e.*"))
    return union_datasets(parts)


def dataset_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every order asked for, with the reason its lines cannot be benchmarked."""
    requested = read_table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("dataset")
    )
    checked = profile.dataset_status(tasks.order_datasets(spark, sf), inner_folds=2)
    return requested.join(checked, "dataset", "left").withColumn(
        "status", F.coalesce("status", F.lit("unknown"))
    )


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [profile.class_counts(m(spark, sf)) for m in (tasks.quality, tasks.toxic)]
    return union_datasets(parts)


def audit_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_audit(tasks.returns_coarse(spark, sf))


def audit_duplicates_hot(spark: SparkSession, sf: str) -> DataFrame:
    """All lines as one dataset per line status: few signatures, many copies of each."""
    coarse = tasks.returns_coarse(spark, sf)
    return audit.duplicate_audit(coarse.with_df(coarse.df.withColumn("dataset", F.col("linestatus"))))


def conflicting_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.conflicting_rows(tasks.returns_coarse(spark, sf))
    return rows.select("dataset", "row_id", "quantity", "discount", "tax", "y")


def _early_late(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = read_table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    shaped = orders.select(
        (F.col("o_custkey") % 7).alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.floor(F.col("o_totalprice") / 100).alias("price_band"),
        F.nullif(F.month("o_orderdate"), F.lit(1)).alias("month"),
        F.col("o_totalprice").alias("target"),
        early.alias("early"),
    )
    return shaped.filter("early").drop("early"), shaped.filter("NOT early").drop("early")


def predictor_overlap(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _early_late(spark, sf)
    return audit.predictor_overlap(train, test, "target", "id")


def shared_signatures(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _early_late(spark, sf)
    return audit.shared_rows(train, test, ["status", "priority", "price_band", "month"])


def missing_both_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells per column of the train and the test side."""
    train, test = _early_late(spark, sf)
    parts = []
    for side, df in (("train", train), ("test", test)):
        framed = df.select(F.lit(side).alias("dataset"), "*").withColumn("y", F.lit(0))
        lf = LabelledFrame(framed, ("id", "price_band", "month"), ("status", "priority"))
        parts.append(profile.missing_by_column(lf))
    return union_datasets(parts).drop("position")


def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").withColumn("dataset", F.col("o_orderstatus"))
    return rounded(audit.target_summary(orders, "o_totalprice", ("dataset",)))


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return audit.first_rows(orders, ["o_orderkey"])


# --- registry contracts -----------------------------------------------------------------


def _text_array(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def supplier_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A registry entry per supplier. One defect kind, by key, in twelve of thirteen entries."""
    rows = tasks.suppliers(spark, sf)
    counts = tasks.returns_rows(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    kind = F.col("key") % 13
    labels = (
        F.when(kind == 1, _text_array("R", "R"))
        .when(kind == 12, _text_array("A", "R"))
        .otherwise(_text_array("R", "other"))
    )
    numeric = (
        F.when(kind == 3, F.array().cast("array<string>"))
        .when(kind == 10, _text_array("quantity", "price", "discount", "tax", "weight"))
        .when(kind == 11, _text_array("quantity", "discount", "tax"))
        .otherwise(_text_array("quantity", "price", "discount", "tax"))
    )
    categorical = (
        F.when(kind == 3, F.array().cast("array<string>"))
        .when(kind == 11, _text_array("price", "linestatus"))
        .otherwise(_text_array("linestatus"))
    )
    excluded = F.when(kind == 4, _text_array("row_id", "tax")).otherwise(_text_array("row_id"))
    return rows.join(counts, "dataset", "left").select(
        "name",
        F.when(kind == 6, F.col("openml_id") - 1).otherwise(F.col("openml_id")).alias("openml_id"),
        "version",
        F.md5("name").alias("md5_checksum"),
        F.lit("").alias("source_url"),
        F.lit("").alias("original_source_url"),
        F.lit("Public").alias("license"),
        "family",
        (kind == 7).alias("clinical"),
        F.lit("label").alias("target"),
        F.when(kind == 2, "X").otherwise("R").alias("positive_class"),
        labels.alias("class_labels"),
        (F.coalesce("rows", F.lit(0)) + (kind == 9).cast("bigint")).alias("expected_rows"),
        numeric.alias("numeric_features"),
        categorical.alias("categorical_features"),
        excluded.alias("excluded_features"),
        F.lit("stratified").alias("split_strategy"),
        F.lit("").alias("split_notes"),
        F.lit("").alias("selection_reason"),
    )


def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    entries = supplier_registry(spark, sf)
    manifest = tasks.suppliers(spark, sf).select(
        "name",
        F.when(F.col("key") % 13 == 6, F.col("openml_id") - 1)
        .otherwise(F.col("openml_id"))
        .alias("openml_id_found"),
        F.col("version").alias("version_found"),
        F.when(F.col("key") % 13 == 8, F.lit("stale"))
        .otherwise(F.md5("name"))
        .alias("md5_checksum_found"),
    )
    rows = tasks.returns_rows(spark, sf).select(
        F.col("dataset").alias("name"),
        F.when(F.col("label") == "R", "R").otherwise("other").alias("label"),
    )
    labels = registry.observed_labels(rows, entries, "label")
    return registry.contract_status(
        entries,
        manifest,
        labels,
        columns=("quantity", "price", "discount", "tax", "linestatus", "row_id"),
        numeric=("quantity", "price", "discount", "tax"),
        target="label",
    )


def registry_listing(spark: SparkSession, sf: str) -> DataFrame:
    return registry.listing(registry.all_general(supplier_registry(spark, sf)))


def requested_names(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers asked for at twice each key, half of them beyond the last: known or unknown."""
    asked = read_table(spark, sf, "supplier").select(
        tasks.supplier_name(F.col("s_suppkey") * 2).alias("name")
    )
    return registry.select_requested(supplier_registry(spark, sf), asked)


# --- splits -----------------------------------------------------------------------------


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(
        tasks.returns(spark, sf), FULL.outer_seeds, FULL.test_size, FULL.inner_folds
    )


def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("dataset", "outer_seed", "row_id", "part")


def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    train = _assigned(spark, sf).filter("part = 'train'")
    return train.select("dataset", "outer_seed", "row_id", "fold")


def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return splits.fold_sizes(_assigned(spark, sf), ["dataset"], FULL.inner_folds)


def characterize_train_parts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_benchmark(spark, sf).train_descriptors())


# --- preprocessing ----------------------------------------------------------------------


def impute_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = prep.numeric_statistics(tasks.returns(spark, sf))
    return rounded(stats.select("dataset", "column", "n_rows", "n_missing", "median", "has_indicator"))


def scaler_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = prep.numeric_statistics(tasks.returns(spark, sf))
    return rounded(
        stats.select(
            "dataset", "column", "imputed_mean", "scale", "indicator_mean", "indicator_scale"
        )
    )


def category_levels(spark: SparkSession, sf: str) -> DataFrame:
    parts = [prep.level_index(m(spark, sf)) for m in (tasks.returns, tasks.quality)]
    return union_datasets(parts)


def encoded_design(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded rows of the quality task, statistics from the training part of seed 42."""
    lf = tasks.quality(spark, sf)
    lf = lf.with_df(lf.df.withColumn("n_chars", F.nullif(F.col("n_chars") % 50, F.lit(0.0))))
    rows = splits.assign_splits(lf, (42,), 0.25, 3, carry=lf.features)
    train = lf.with_df(rows.filter("part = 'train'"))
    fitted = prep.fit(train)
    encoded = prep.encode(lf.with_df(rows), train, fitted, scaled=True)
    return rounded(prep.long_form(encoded, ("dataset",)))


def matrix_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Dense sizes of every supplier against a budget that some exceed and one may just meet."""
    widths = prep.encoded_widths(tasks.returns(spark, sf))
    return prep.matrix_guard(widths, limit_bytes=600 * 8 * C.FLOAT_BYTES)


def fold_widths(spark: SparkSession, sf: str) -> DataFrame:
    bench = _benchmark(spark, sf)
    train = bench.frame.with_df(
        bench.assigned.filter("part = 'train'"), keys=("dataset", "outer_seed")
    )
    widths = prep.fold_widths(train, FULL.inner_folds)
    return widths.select("dataset", "outer_seed", F.posexplode("widths").alias("stage", "width"))


# --- benchmark --------------------------------------------------------------------------


def _benchmark(spark: SparkSession, sf: str, protocol=FULL) -> benchmark.RuleBenchmark:
    return benchmark.rule_benchmark(tasks.returns(spark, sf), tasks.RETURNS_RULES, protocol)


def work_list(spark: SparkSession, sf: str) -> DataFrame:
    return trials.work_list(tasks.suppliers(spark, sf), "dataset", FULL)


def balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks.returns_rows(spark, sf).withColumn(
        "prediction", (F.col("quantity") > 25).cast("int")
    )
    return rounded(scoring.balanced_accuracy(rows, ["dataset"]))


def roc_auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    lines = tasks.returns_rows(spark, sf).select("dataset", "y", F.col("price").alias("score"))
    events = tasks.purchase(spark, sf).df.select("dataset", "y", F.col("value").alias("score"))
    return rounded(scoring.roc_auc(union_datasets([lines, events]), ["dataset"]))


def trial_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every rule on every inner fold and of its refit on the test rows."""
    return rounded(_benchmark(spark, sf).scores)


def trial_means(spark: SparkSession, sf: str) -> DataFrame:
    means = _benchmark(spark, sf).trials()
    return rounded(
        means.select(
            "dataset", "outer_seed", "family", "candidate_order", "status", "completed_folds",
            "mean_balanced_accuracy", "mean_roc_auc",
        )
    )


def select_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_benchmark(spark, sf).selected())


def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = trials.rank_candidates(_benchmark(spark, sf).trials(), ["dataset", "outer_seed"])
    return ranked.select("dataset", "outer_seed", "family", "candidate_order", "candidate_rank")


def paired_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_benchmark(spark, sf).paired())


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    """The meta-table with registry identity, one row per supplier dataset."""
    identity = tasks.suppliers(spark, sf).select(
        "dataset", "openml_id", "version", "family", "clinical"
    )
    return identity.join(_benchmark(spark, sf).meta_table(), "dataset")


def _stored_meta(spark: SparkSession, sf: str) -> DataFrame:
    """The meta-table written once, since recommenders read it several times."""
    return stored(_meta(spark, sf))


def meta_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_meta(spark, sf))


def benchmark_index(spark: SparkSession, sf: str) -> DataFrame:
    """One status per requested dataset of a batch: skipped, failure, excluded or success."""
    asked = tasks.suppliers(spark, sf).select("dataset", "clinical")
    outcome = _benchmark(spark, sf).outcome().select("dataset", "primary_success")
    guard = profile.dataset_status(tasks.returns(spark, sf), FULL.inner_folds).select(
        "dataset", F.col("status").alias("guard")
    )
    status = (
        F.when(F.col("clinical"), "skipped")
        .when(F.coalesce("guard", F.lit("unknown")) != "ok", "failure")
        .when(F.col("primary_success"), "success")
        .otherwise("excluded")
    )
    return (
        asked.join(guard, "dataset", "left")
        .join(outcome, "dataset", "left")
        .withColumn("status", status)
        .select(
            "dataset",
            "status",
            (F.col("status") == "success").alias("research_valid"),
            F.when(F.col("status") == "skipped", "clinical holdout")
            .when(F.col("status") == "failure", F.coalesce("guard", F.lit("unknown")))
            .alias("reason"),
        )
    )


# --- recommender ------------------------------------------------------------------------


def recommend_dummy_lofo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recommend.evaluate_recommender(_stored_meta(spark, sf), "dummy_mean")[0])


def recommend_ridge1_lofo(spark: SparkSession, sf: str) -> DataFrame:
    meta = _stored_meta(spark, sf)
    predicted = recommend.ridge_predictions(meta, ["missing_fraction"])
    return rounded(recommend.evaluate(meta, predicted))


def recommend_ridge_lofo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recommend.evaluate_recommender(_stored_meta(spark, sf), "ridge")[0])


def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recommend.evaluate_recommender(_stored_meta(spark, sf), "dummy_mean")[1])


def recommend_tree_lofo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recommend.evaluate_recommender(_stored_meta(spark, sf), "decision_tree")[0])


def recommend_forest_lofo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recommend.evaluate_recommender(_stored_meta(spark, sf), "random_forest")[0])


def in_sample_dummy(spark: SparkSession, sf: str) -> DataFrame:
    fitted = recommend.in_sample(_stored_meta(spark, sf), "dummy_mean")
    return rounded(fitted.select("dataset", "predicted_gap", "recommendation", "warning"))


def in_sample_ridge(spark: SparkSession, sf: str) -> DataFrame:
    fitted = recommend.in_sample(_stored_meta(spark, sf), "ridge")
    return rounded(fitted.select("dataset", "predicted_gap", "recommendation", "warning"))


# --- evidence ---------------------------------------------------------------------------


def _recorded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Full run artifacts of every supplier, damaged by kind (key modulo 12).

    0-2 intact; 3 excluded status; 4 cut in half; 5 a NaN token; 6/7 the same name; 8 a wrong
    class count and the source id of its neighbour 9; 10 another project; 11 a stray byte.
    """
    people = tasks.suppliers(spark, sf)
    kind, block = F.col("key") % 12, F.floor(F.col("key") / 12)
    shared_name = F.concat(F.lit("shared-"), block.cast("string"))
    identity = people.select(
        "dataset",
        F.when(kind.isin(6, 7), shared_name).otherwise(F.col("name")).alias("name"),
        F.when(kind == 8, F.col("openml_id") + 1).otherwise(F.col("openml_id")).alias("openml_id"),
        "version",
        "family",
        "clinical",
    )
    runs = benchmark.run_artifacts(_benchmark(spark, sf), identity)
    text = F.col("artifact")
    damaged = (
        F.when(kind == 3, F.replace(text, F.lit('"success","status_note"'), F.lit('"excluded","status_note"')))
        .when(kind == 4, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .when(kind == 5, F.replace(text, F.lit('"research_valid":true'), F.lit('"research_valid":NaN')))
        .when(kind == 8, F.replace(text, F.lit('"n_classes":2,'), F.lit('"n_classes":3,')))
        .when(kind == 10, F.replace(text, F.lit(f'"project":"{C.PROJECT}"'), F.lit('"project":"other"')))
        .otherwise(text)
    )
    content = damaged.cast("binary")
    stray = F.when(kind == 11, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    return runs.join(people.select("dataset", "key"), "dataset").select(
        F.concat(F.col("dataset"), F.lit(".full.json")).alias("path"),
        F.lit(0).alias("occurrence"),
        stray.alias("content"),
    )


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    """Validated artifacts, written once because the duplicate policy looks at them twice."""
    return stored(evidence.validate(_recorded_runs(spark, sf), FULL), LONG_ROWS)


def admission_ledger(spark: SparkSession, sf: str) -> DataFrame:
    entries = evidence.ledger(_validated(spark, sf))
    return entries.select("path", "outcome", "code", "reason", "validation_reason")


def admission_report(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.report_summary(evidence.ledger(_validated(spark, sf)), FULL)


def conflict_members(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.conflict_members(_validated(spark, sf))


def meta_from_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence.meta_rows(evidence.ledger(_validated(spark, sf)), FULL)
    return rounded(rows.drop("extra_descriptors"))


def smoke_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Smoke runs of every supplier judged in both modes: valid as smoke, never as full."""
    runs = benchmark.run_artifacts(_benchmark(spark, sf, SMOKE), tasks.suppliers(spark, sf))
    files = stored(artifacts.from_text(runs, F.col("dataset"), F.col("artifact")))
    parts = [
        evidence.ledger(stored(evidence.validate(files, p))).select(
            F.lit(p.name).alias("mode"), "path", "outcome", "code", "reason"
        )
        for p in (SMOKE, FULL)
    ]
    return union_datasets(parts)


# --- Spark ML ---------------------------------------------------------------------------


def ml_smoke_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Smoke protocol on the quality task, with all iterations: minutes even on small tables."""
    result = ml.run_dataset(tasks.quality(spark, sf), "doc_quality", SMOKE)
    return rounded(result.drop("fit_seconds", "error"))


def ml_demo(spark: SparkSession, sf: str) -> DataFrame:
    """One fit of either baseline with all iterations; like the smoke run, called by hand."""
    result = ml.demo(tasks.toxic(spark, sf), "doc_toxic", 42)
    return rounded(result.drop("fit_seconds", "error"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        load_summary,
        contract_checks,
        registry_listing,
        requested_names,
        characterize_single,
        characterize_tables,
        characterize_grouped,
        characterize_train_parts,
        missing_by_column,
        missing_both_sides,
        constant_columns,
        feature_roles,
        dataset_status,
        class_counts,
        audit_duplicates,
        audit_duplicates_hot,
        conflicting_rows,
        predictor_overlap,
        shared_signatures,
        target_summary,
        first_rows,
        stratified_holdout,
        stratified_kfold,
        fold_sizes,
        impute_stats,
        scaler_stats,
        category_levels,
        encoded_design,
        matrix_guard,
        fold_widths,
        work_list,
        balanced_accuracy,
        roc_auc_exact,
        trial_folds,
        trial_means,
        select_candidate,
        candidate_ranking,
        paired_gap,
        meta_table,
        benchmark_index,
        recommend_dummy_lofo,
        recommend_ridge1_lofo,
        recommend_ridge_lofo,
        evaluation_summary,
        recommend_tree_lofo,
        recommend_forest_lofo,
        in_sample_dummy,
        in_sample_ridge,
        admission_ledger,
        admission_report,
        conflict_members,
        meta_from_evidence,
        smoke_admission,
    )
}
