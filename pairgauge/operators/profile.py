"""Descriptors, class counts, missing values and constant columns of every dataset at once.

One pass: rows are pre-aggregated per (keys, class) with a map-side combine, then the small
per-class rows are folded into one row per dataset. Distinct counts are avoided: a column is
constant when all its cells are missing, or none is and its minimum equals its maximum. For
text that is the minimum and maximum of a 128-bit fingerprint: fixed-width state keeps the
aggregation hash-based, where text state would sort every row first.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import LabelledFrame, is_infinite


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def class_counts(lf: LabelledFrame) -> DataFrame:
    """Rows per dataset and class."""
    return lf.df.groupBy(*lf.keys, lf.target).agg(F.count(F.lit(1)).alias("class_rows"))


def column_statistics(lf: LabelledFrame) -> DataFrame:
    """One row per dataset with counts, class sizes and per-column statistics.

    Per feature ``c``: ``c__missing`` and its range (of a fingerprint for text); over all: ``n_rows``,
    ``target_missing``, ``infinite_cells``, ``incomplete_rows``, ``n_classes``,
    ``minority_rows``, ``majority_rows``.
    """
    per_class = [F.count(F.lit(1)).alias("class_rows")]
    for name in lf.features:
        per_class.append(F.sum(_flag(F.col(name).isNull())).alias(f"{name}__missing"))
        for state, value in _range_columns(lf, name).items():
            per_class += [F.min(value).alias(f"{state}__min"), F.max(value).alias(f"{state}__max")]
    any_missing = reduce(or_, [F.col(c).isNull() for c in lf.features])
    per_class.append(F.sum(_flag(any_missing)).alias("incomplete_rows"))
    infinite = [F.coalesce(_flag(is_infinite(F.col(c))), F.lit(0)) for c in lf.numeric]
    per_class.append(F.sum(reduce(add, infinite, F.lit(0))).alias("infinite_cells"))

    labelled = F.col(lf.target).isNotNull()
    folded = [
        F.sum("class_rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(~labelled, F.col("class_rows"))), F.lit(0)).alias(
            "target_missing"
        ),
        F.sum(_flag(labelled)).alias("n_classes"),
        F.min(F.when(labelled, F.col("class_rows"))).alias("minority_rows"),
        F.max(F.when(labelled, F.col("class_rows"))).alias("majority_rows"),
        F.sum("incomplete_rows").alias("incomplete_rows"),
        F.sum("infinite_cells").alias("infinite_cells"),
    ]
    for name in lf.features:
        folded.append(F.sum(f"{name}__missing").alias(f"{name}__missing"))
        for state in _range_columns(lf, name):
            folded += [
                F.min(f"{state}__min").alias(f"{state}__min"),
                F.max(f"{state}__max").alias(f"{state}__max"),
            ]
    return lf.df.groupBy(*lf.keys, lf.target).agg(*per_class).groupBy(*lf.keys).agg(*folded)


def _range_columns(lf: LabelledFrame, name: str) -> dict[str, Column]:
    """Fixed-width values whose range tells whether a column has one value only."""
    cell = F.col(name)
    if name in lf.numeric:
        return {name: cell}
    return {
        f"{name}__a": F.when(cell.isNotNull(), F.xxhash64(cell)),
        f"{name}__b": F.when(cell.isNotNull(), F.xxhash64(F.lit(1), cell)),
    }


def is_constant(lf: LabelledFrame, name: str) -> Column:
    missing = F.col(f"{name}__missing")
    single = reduce(
        and_, [F.col(f"{s}__min") == F.col(f"{s}__max") for s in _range_columns(lf, name)]
    )
    return (missing == F.col("n_rows")) | ((missing == 0) & single)


def profile_status() -> Column:
    """Why a dataset cannot be described, or 'ok'."""
    return (
        F.when(F.col("n_rows") == 0, "empty")
        .when(F.col("target_missing") > 0, "missing_target")
        .when(F.col("n_classes") < 2, "one_class")
        .when(F.col("infinite_cells") > 0, "infinite")
        .otherwise("ok")
    )


def describe(statistics: DataFrame, lf: LabelledFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The ten descriptors from column statistics; NULL where ``status`` is not 'ok'."""
    width = len(lf.features)
    rows = F.col("n_rows")
    missing = reduce(add, [F.col(f"{c}__missing") for c in lf.features])
    constant = reduce(add, [_flag(is_constant(lf, c)) for c in lf.features])
    values = {
        "n_samples": rows,
        "n_features": F.lit(width).cast("long"),
        "n_classes": F.col("n_classes"),
        "samples_per_feature": rows / F.lit(width),
        "categorical_fraction": F.lit(1 - len(lf.numeric) / width),
        "missing_fraction": missing / (rows * width),
        "rows_with_missing_fraction": F.col("incomplete_rows") / rows,
        "constant_feature_fraction": constant / F.lit(width),
        "minority_class_fraction": F.col("minority_rows") / rows,
        "imbalance_ratio": F.col("majority_rows") / F.col("minority_rows"),
    }
    good = F.col("status") == "ok"
    return statistics.withColumn("status", profile_status()).select(
        *lf.keys,
        *extra,
        "status",
        *[F.when(good, value).alias(name) for name, value in values.items()],
    )


def characterize(lf: LabelledFrame) -> DataFrame:
    """Ten descriptors and a status per dataset."""
    return describe(column_statistics(lf), lf)


def _per_column(lf: LabelledFrame, statistics: DataFrame, **fields) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("column"),
                *[make(name).alias(alias) for alias, make in fields.items()],
            )
            for position, name in enumerate(lf.features)
        ]
    )
    return statistics.select(*lf.keys, F.explode(entries).alias("entry")).select(
        *lf.keys, "entry.*"
    )


def missing_by_column(lf: LabelledFrame) -> DataFrame:
    """(keys, position, column, missing) where any cell is missing."""
    long = _per_column(lf, column_statistics(lf), missing=lambda c: F.col(f"{c}__missing"))
    return long.filter("missing > 0")


def constant_columns(lf: LabelledFrame) -> DataFrame:
    """(keys, position, column) of columns with at most one value, missing counted as one."""
    long = _per_column(lf, column_statistics(lf), constant=lambda c: is_constant(lf, c))
    return long.filter("constant").drop("constant")


def load_summary(lf: LabelledFrame, positive: str, negative: str) -> DataFrame:
    """Size, missing cells, rows per label and the label encoding of each dataset."""
    incomplete = reduce(add, [_flag(F.col(c).isNull()) for c in lf.features])
    return (
        lf.df.groupBy(*lf.keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(incomplete).alias("missing_cells"),
            F.count_if(F.col(lf.target) == 0).alias("negative_rows"),
            F.count_if(F.col(lf.target) == 1).alias("positive_rows"),
        )
        .select(
            *lf.keys,
            "n_rows",
            F.lit(len(lf.features)).cast("long").alias("n_features"),
            "missing_cells",
            F.create_map(
                F.lit(negative), F.col("negative_rows"), F.lit(positive), F.col("positive_rows")
            ).alias("class_counts"),
            F.create_map(F.lit(negative), F.lit(0), F.lit(positive), F.lit(1)).alias(
                "target_encoding"
            ),
        )
    )


def dataset_status(lf: LabelledFrame, inner_folds: int) -> DataFrame:
    """Whether each dataset can be described and benchmarked, with the first obstacle."""
    need = max(2, inner_folds)
    base = profile_status()
    status = (
        F.when(base != "ok", base)
        .when(F.col("n_classes") != 2, "not_binary")
        .when(F.col("minority_rows") < need, "too_few_rows")
        .otherwise("ok")
    )
    return column_statistics(lf).select(
        *lf.keys,
        "n_rows",
        "n_classes",
        "minority_rows",
        status.alias("status"),
    )
