"""Duplicate, conflict and overlap audits.

Rows are grouped by their real feature values, never by a hash of them, so equal signatures
are equal rows. Each audit is one shuffle with map-side combine: a signature shared by a third
of all rows reaches the reducers as one pre-counted row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import LabelledFrame
from . import profile

AUDIT_NOTE = (
    "Duplicate counts are for diagnosis; rows with conflicting targets need a manual look. "
    "Nothing is deleted."
)


def signature_counts(lf: LabelledFrame) -> DataFrame:
    """Rows per dataset and feature signature, split by binary class."""
    return lf.df.groupBy(*lf.keys, *lf.features).agg(
        F.count(F.lit(1)).alias("sig_rows"),
        F.count_if(F.col(lf.target) == 0).alias("sig_negative"),
        F.count_if(F.col(lf.target) == 1).alias("sig_positive"),
    )


def duplicate_audit(lf: LabelledFrame) -> DataFrame:
    """Duplicate and conflicting rows and groups per dataset; all members of a group count."""
    repeated = F.col("sig_rows") > 1
    negative, positive = F.col("sig_negative"), F.col("sig_positive")
    mixed = (negative > 0) & (positive > 0)
    zero = F.lit(0).cast("long")
    exact_rows = F.when(negative > 1, negative).otherwise(zero) + F.when(
        positive > 1, positive
    ).otherwise(zero)
    exact_groups = (negative > 1).cast("long") + (positive > 1).cast("long")
    return (
        signature_counts(lf)
        .groupBy(*lf.keys)
        .agg(
            F.sum("sig_rows").alias("n_rows"),
            F.sum(F.when(repeated, F.col("sig_rows")).otherwise(zero)).alias(
                "duplicate_feature_rows"
            ),
            F.count_if(repeated).alias("duplicate_feature_groups"),
            F.sum(exact_rows).alias("exact_duplicate_rows"),
            F.sum(exact_groups).alias("exact_duplicate_groups"),
            F.sum(F.when(mixed, F.col("sig_rows")).otherwise(zero)).alias(
                "conflicting_target_signature_rows"
            ),
            F.count_if(mixed).alias("conflicting_target_signature_groups"),
        )
    )


def conflicting_rows(lf: LabelledFrame) -> DataFrame:
    """The rows whose signature occurs with both targets.

    A semi-join on null-safe keys; the rows of a hot signature stay spread over their
    tasks when the signature side is broadcast, and are split by skew handling otherwise.
    """
    sides = [*lf.keys, *lf.features]
    mixed = (
        signature_counts(lf)
        .filter("sig_negative > 0 AND sig_positive > 0")
        .select(*[F.col(c).alias(f"{c}__sig") for c in sides])
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}__sig")) for c in sides]
    return lf.df.join(mixed, same, "left_semi")


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def shared_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows present on both sides; missing matches missing."""
    return left.select(*columns).intersect(right.select(*columns))


def _sides(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n_left, n_right): rows of each side per signature."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    stacked = left.select(*columns, one.alias("in_left"), none.alias("in_right")).unionByName(
        right.select(*columns, none.alias("in_left"), one.alias("in_right"))
    )
    return stacked.groupBy(*columns).agg(F.sum("in_left").alias("n_left"), F.sum("in_right").alias("n_right"))


def _overlap(counted: DataFrame, scope: str) -> DataFrame:
    n_left, n_right, none = F.col("n_left"), F.col("n_right"), F.lit(0).cast("long")
    return counted.agg(
        F.count_if((n_left > 0) & (n_right > 0)).alias("shared_signatures"),
        F.coalesce(F.sum(F.when(n_left > 1, n_left)), none).alias("left_repeated_rows"),
        F.coalesce(F.sum(F.when(n_right > 1, n_right)), none).alias("right_repeated_rows"),
    ).select(F.lit(scope).alias("scope"), "*")


def _no_overlap(df: DataFrame, scope: str) -> DataFrame:
    names = ["shared_signatures", "left_repeated_rows", "right_repeated_rows"]
    none = [F.lit(0).cast("long").alias(n) for n in names]
    return df.sparkSession.range(1).select(F.lit(scope).alias("scope"), *none)


def overlap_counts(left: DataFrame, right: DataFrame, columns: list[str], scope: str) -> DataFrame:
    """One row: signatures on both sides and rows in repeated signatures of each side.

    Both sides go through one aggregation by signature instead of an intersect and two
    duplicate counts.
    """
    return _overlap(_sides(left, right, columns), scope) if columns else _no_overlap(left, scope)


def predictor_overlap(
    train: DataFrame, test: DataFrame, target: str, id_column: str | None = None
) -> DataFrame:
    """Leak check between two tables over their shared predictors, with and without the id.

    Rows are counted once, by all shared columns; signatures without the id add those counts up.
    """
    shared = [c for c in train.columns if c != target and c in test.columns]
    signature = [c for c in shared if c != id_column]
    if not signature:
        return overlap_counts(train, test, shared, "with_id").unionByName(_no_overlap(train, "without_id"))
    full = _sides(train, test, shared)
    rolled = full.groupBy(*signature).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return _overlap(full, "with_id").unionByName(_overlap(rolled, "without_id"))


def target_summary(df: DataFrame, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, range, mean and sample deviation of a numeric target."""
    value = F.col(target)
    return df.groupBy(*keys).agg(
        F.count(value).alias("target_count"),
        F.min(value).alias("target_min"),
        F.max(value).alias("target_max"),
        F.avg(value).alias("target_mean"),
        F.stddev_samp(value).alias("target_std"),
    )


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def audit_record(lf: LabelledFrame) -> DataFrame:
    """One record per dataset: size, classes, missing and constant columns, duplicates, and the note.

    Everything but the duplicates comes from one set of column statistics; ``missing_by_column`` holds
    columns with gaps only, ``constant_columns`` are in column order.
    """
    keys = list(lf.keys)
    statistics = profile.column_statistics(lf)
    counts = profile.class_counts(lf).where(F.col(lf.target).isNotNull()).groupBy(*keys)
    entry = F.struct(F.col(lf.target).alias("key"), F.col("class_rows").alias("value"))
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("class_counts"))
    gap = [
        F.when(F.col(f"{c}__missing") > 0, F.struct(F.lit(c).alias("key"), F.col(f"{c}__missing").alias("value")))
        for c in lf.features
    ]
    flat = [F.when(profile.is_constant(lf, c), F.lit(c)) for c in lf.features]
    present = lambda cells: F.filter(F.array(*cells), lambda e: e.isNotNull())
    described = statistics.select(
        *keys,
        F.lit(len(lf.features)).cast("long").alias("n_features"),
        sum((F.col(f"{c}__missing") for c in lf.features), F.lit(0)).cast("long").alias("missing_cells"),
        F.map_from_entries(present(gap)).alias("missing_by_column"),
        present(flat).alias("constant_columns"),
    )
    joined = duplicate_audit(lf).join(described, keys).join(counts, keys, "left")
    return joined.withColumn("notes", F.lit(AUDIT_NOTE))
