"""Preprocessing learned from training rows only, kept as statistics tables.

Nothing is materialised while fitting: medians, missing indicators, scaling and category
levels are rows of small tables; encoded rows are produced by joining them to the data.
Pass training rows grouped by (dataset, split, fold) through ``keys`` to fit every fold of
every dataset in one job.
"""

from __future__ import annotations

import sys
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..frame import LabelledFrame
from ..functions.exact import SKETCH_ACCURACY, exact_medians

INDICATOR_PREFIX = "missingindicator_"
_EPSILON = sys.float_info.epsilon


def check_columns(columns: list[str], needed: tuple[str, ...]) -> None:
    """Training and scoring tables need unique columns and every feature; others are ignored."""
    if len(set(columns)) != len(columns):
        raise ValueError("Feature columns must be unique.")
    absent = sorted(set(needed) - set(columns))
    if absent:
        raise ValueError(f"Missing preprocessing columns: {absent}")


def numeric_statistics(train: LabelledFrame, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Imputation and scaling of each numeric column.

    Columns: keys, column, n_rows, n_missing, median (0 if nothing was seen), has_indicator,
    and mean/scale of the imputed column and of its indicator. The moments after imputation
    follow from those before it: n_missing copies of the median join the present values.
    """
    base = exact_medians(train.df, train.keys, train.numeric, accuracy)
    n, present, missing = F.col("n_rows"), F.col("present"), F.col("n_missing")
    share = missing / n
    mean = (
        F.coalesce(F.col("mean"), F.lit(0.0)) * present + F.col("median") * missing
    ) / n
    spread = (
        present
        * (
            F.coalesce(F.col("variance"), F.lit(0.0))
            + F.pow(F.coalesce(F.col("mean"), F.lit(0.0)) - F.col("imputed_mean"), 2)
        )
        + missing * F.pow(F.col("median") - F.col("imputed_mean"), 2)
    ) / n
    return (
        base.withColumn("n_missing", n - present)
        .withColumn("median", F.coalesce(F.col("median"), F.lit(0.0)))
        .withColumn("has_indicator", missing > 0)
        .withColumn("imputed_mean", mean)
        .withColumn("imputed_variance", spread)
        .withColumn("indicator_mean", share)
        .withColumn("indicator_variance", share * (1 - share))
        .select(
            *train.keys,
            "column",
            "n_rows",
            "n_missing",
            "median",
            "has_indicator",
            "imputed_mean",
            "imputed_variance",
            _scale(F.col("imputed_variance"), F.col("imputed_mean"), n).alias("scale"),
            "indicator_mean",
            "indicator_variance",
            _scale(F.col("indicator_variance"), share, n).alias("indicator_scale"),
        )
    )


def _scale(variance: Column, mean: Column, rows: Column) -> Column:
    """Population deviation; a column constant up to rounding is divided by 1."""
    noise = rows * F.lit(_EPSILON) * variance + F.pow(rows * mean * F.lit(_EPSILON), 2)
    return F.when(variance > noise, F.sqrt(variance)).otherwise(F.lit(1.0))


def filled_level(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(C.MISSING_LEVEL))


def category_levels(train: LabelledFrame) -> DataFrame:
    """(keys, column, level, level_rows): distinct training levels as rows, never as one array."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), filled_level(c).alias("level"))
            for c in train.categorical
        ]
    )
    return (
        train.df.select(*train.keys, F.explode(entries).alias("e"))
        .groupBy(*train.keys, "e.column", "e.level")
        .agg(F.count(F.lit(1)).alias("level_rows"))
    )


def encoded_widths(train: LabelledFrame) -> DataFrame:
    """(keys, n_rows, n_encoded_features) without building the encoded matrix.

    Width = numeric columns + one indicator per column with training gaps + all levels.
    """
    sizes = [F.count(F.lit(1)).alias("n_rows")]
    indicators = F.lit(0).cast("long")
    for name in train.numeric:
        sizes.append((F.count(F.lit(1)) > F.count(name)).cast("long").alias(f"{name}__gap"))
        indicators = indicators + F.col(f"{name}__gap")
    base = (
        train.df.groupBy(*train.keys)
        .agg(*sizes)
        .select(*train.keys, "n_rows", indicators.alias("indicators"))
    )
    width = F.lit(len(train.numeric)).cast("long") + F.col("indicators")
    if train.categorical:
        counted = category_levels(train).groupBy(*train.keys).agg(
            F.count(F.lit(1)).alias("levels")
        )
        base = base.join(counted, list(train.keys))
        width = width + F.col("levels")
    return base.select(*train.keys, "n_rows", width.alias("n_encoded_features"))


def fold_widths(train: LabelledFrame, inner_folds: int) -> DataFrame:
    """(keys, widths): encoded width of each inner fit (leaving out fold 0, 1, ..) and of the refit.

    A level or a gap counts for a fit when some other fold has it, so per-fold counts of one
    pass give every width; the rows are not repeated per fit.
    """
    keys = list(train.keys)
    stages = range(inner_folds + 1)
    numbers = range(inner_folds)

    def seen(prefix: str, stage: int) -> Column:
        rows = [F.col(f"{prefix}{f}") for f in numbers if f != stage]
        return (F.greatest(*rows, F.lit(0).cast("long")) > 0).cast("long")

    gaps = [
        F.count_if((F.col("fold") == f) & F.col(c).isNull()).alias(f"{c}__gap{f}")
        for c in train.numeric
        for f in numbers
    ]
    base = train.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_rows_seen"), *gaps)
    fixed = F.lit(len(train.numeric)).cast("long")
    totals = [
        reduce(add, [seen(f"{c}__gap", s) for c in train.numeric], fixed) for s in stages
    ]
    if train.categorical:
        entries = F.array(
            *[
                F.struct(F.lit(c).alias("column"), filled_level(c).alias("level"))
                for c in train.categorical
            ]
        )
        levels = (
            train.df.select(*keys, "fold", F.explode(entries).alias("e"))
            .groupBy(*keys, "e.column", "e.level")
            .agg(*[F.count_if(F.col("fold") == f).alias(f"level{f}") for f in numbers])
            .groupBy(*keys)
            .agg(*[F.sum(seen("level", s)).alias(f"levels{s}") for s in stages])
        )
        base = base.join(levels, keys)
        totals = [t + F.col(f"levels{s}") for s, t in zip(stages, totals, strict=True)]
    return base.select(*keys, F.array(*totals).alias("widths"))


def dense_bytes(rows: Column, width: Column) -> Column:
    return rows * width * F.lit(C.FLOAT_BYTES)


def matrix_guard(widths: DataFrame, limit_bytes: int = C.MATRIX_LIMIT_BYTES) -> DataFrame:
    """Size each dense float64 matrix would have, and whether the budget allows it."""
    size = dense_bytes(F.col("n_rows"), F.col("n_encoded_features"))
    return widths.withColumn("dense_bytes", size).withColumn(
        "status", F.when(F.col("dense_bytes") > limit_bytes, "too_large").otherwise("ok")
    )


def fit(train: LabelledFrame, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """One row per dataset, whatever its size, with everything needed to encode rows.

    ``matrix_guard`` reports which datasets are too wide for a dense matrix; nothing is left out
    here. The lists collected for a dataset hold the levels of its own columns.
    """
    keys = list(train.keys)
    fitted = encoded_widths(train).select(*keys, "n_rows", "n_encoded_features")
    if train.numeric:
        entry = F.struct(
            F.array_position(F.array(*[F.lit(c) for c in train.numeric]), F.col("column")).alias(
                "position"
            ),
            "column",
            "median",
            "has_indicator",
            "imputed_mean",
            "scale",
            "indicator_mean",
            "indicator_scale",
        )
        stats = (
            numeric_statistics(train, accuracy)
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(entry)).alias("numeric_stats"))
        )
        fitted = fitted.join(stats, keys)
    if train.categorical:
        order = F.array(*[F.lit(c) for c in train.categorical])
        per_column = (
            category_levels(train)
            .groupBy(*keys, "column")
            .agg(F.array_sort(F.collect_list("level")).alias("levels"))
        )
        levels = per_column.groupBy(*keys).agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.array_position(order, F.col("column")).alias("position"),
                             "column", "levels")
                )
            ).alias("category_stats")
        )
        fitted = fitted.join(levels, keys)
    return fitted


def feature_names(train: LabelledFrame) -> Column:
    """Names of the encoded columns of a fitted row, in output order."""
    parts = []
    if train.numeric:
        stats = F.col("numeric_stats")
        gaps = F.filter(stats, lambda s: s["has_indicator"])
        parts.append(F.transform(stats, lambda s: s["column"]))
        parts.append(
            F.transform(gaps, lambda s: F.concat(F.lit(INDICATOR_PREFIX), s["column"]))
        )
    if train.categorical:
        named = F.transform(
            F.col("category_stats"),
            lambda s: F.transform(
                s["levels"], lambda level: F.concat(s["column"], F.lit("_"), level)
            ),
        )
        parts.append(F.flatten(named))
    return F.concat(*parts)


def _pick(names: tuple[str, ...], position: Column, value) -> Column:
    return F.element_at(F.array(*[value(c) for c in names]), position.cast("int"))


def feature_values(train: LabelledFrame, scaled: bool) -> Column:
    """Encoded values of a row joined to its fitted statistics.

    Imputed numerics, then indicators of columns that had training gaps, then one-hot levels;
    an unseen level gives zeros. Scaling touches numerics and indicators only.
    """

    def standard(value: Column, mean: Column, scale: Column) -> Column:
        return (value - mean) / scale if scaled else value

    parts = []
    if train.numeric:
        stats = F.col("numeric_stats")
        gaps = F.filter(stats, lambda s: s["has_indicator"])

        def cell(s):
            return _pick(train.numeric, s["position"], F.col)

        def gap(s):
            return _pick(train.numeric, s["position"], lambda c: F.col(c).isNull())

        parts.append(
            F.transform(
                stats,
                lambda s: standard(
                    F.coalesce(cell(s), s["median"]), s["imputed_mean"], s["scale"]
                ),
            )
        )
        parts.append(
            F.transform(
                gaps,
                lambda s: standard(
                    gap(s).cast("double"), s["indicator_mean"], s["indicator_scale"]
                ),
            )
        )
    if train.categorical:
        hot = F.transform(
            F.col("category_stats"),
            lambda s: F.transform(
                s["levels"],
                lambda level: (
                    level == _pick(train.categorical, s["position"], filled_level)
                ).cast("double"),
            ),
        )
        parts.append(F.flatten(hot))
    return F.concat(*parts)


def encode(
    rows: LabelledFrame, train: LabelledFrame, fitted: DataFrame, scaled: bool = False
) -> DataFrame:
    """(keys, row_id, y, names, values): the dense encoded rows."""
    check_columns(rows.df.columns, train.features)
    keys = list(train.keys)
    kept = [c for c in ("outer_seed", "part", "fold") if c in rows.df.columns and c not in keys]
    return rows.df.join(fitted, keys).select(
        *keys,
        *kept,
        rows.row_id,
        rows.target,
        feature_names(train).alias("names"),
        feature_values(train, scaled).alias("values"),
    )


def long_form(encoded: DataFrame, keys: tuple[str, ...], row_id: str = "row_id") -> DataFrame:
    """(keys, row_id, position, name, value) of encoded rows."""
    pairs = F.arrays_zip("names", "values")
    return encoded.select(
        *keys, row_id, F.posexplode(pairs).alias("position", "cell")
    ).select(*keys, row_id, "position", F.col("cell.names").alias("name"),
             F.col("cell.values").alias("value"))


def level_index(train: LabelledFrame) -> DataFrame:
    """(keys, column, level, level_index): one-hot position inside each column, code-point order."""
    keys = list(train.keys)
    ordered = Window.partitionBy(*keys, "column").orderBy("level")
    return category_levels(train).withColumn("level_index", F.row_number().over(ordered) - 1)
