"""Imputation and scaling statistics of every training set of every fold, from one table of counted cells.

A cell is a distinct value of a column with the number of rows in each fold. What a fold's training set sees
is all cells minus the fold's counts, so ranks, means and spreads of all folds follow from one scan and one
set of running totals. A column of a bounded number of cells is added up in one window; beyond that, running
totals go over levels of the value, never over a whole column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_totals, value_levels
from ..session import stored

#: Columns of at most this many distinct values in a training set are added up in one window.
LISTED_CELLS = 65536


def _cells(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], fold: str, k: int) -> DataFrame:
    entry = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") + F.lit(0.0)).alias("value")) for c in columns])
    )
    counts = [F.count_if(F.col(fold) == f).alias(f"c{f}") for f in range(k)]
    return rows.select(*keys, fold, entry.alias("e")).groupBy(*keys, "e.column", "e.value").agg(*counts)


def fold_statistics(
    train: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int, fold: str = "fold", listed: int = LISTED_CELLS
) -> DataFrame:
    """(keys, fold, column, n_rows, n_missing, median, has_indicator, imputed_mean, scale).

    ``train`` holds the training rows with their fold 0..k-1; the row of fold f describes the rows of all
    other folds. The median of nothing is 0, a spread of 0 is scaled by 1, and the moments are those of the
    imputed column.
    """
    keys = list(keys)
    folds = range(k)
    cells = stored(_cells(train, keys, columns, fold, k))
    by = [*keys, "column"]
    present = cells.where("value IS NOT NULL")
    other = lambda name, f: sum((F.col(name.format(g)) for g in folds if g != f), F.lit(0))
    totals = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        *[F.sum(f"c{f}").alias(f"n{f}") for f in folds],
        *[F.sum(F.when(F.col("value").isNotNull(), F.col(f"c{f}")).otherwise(0)).alias(f"p{f}") for f in folds],
        # Any value near the middle keeps later sums from cancelling.
        (F.sum(F.col("value") * sum(F.col(f"c{f}") for f in folds)) / F.nullif(F.sum(F.when(F.col("value").isNotNull(), sum(F.col(f"c{f}") for f in folds))), F.lit(0))).alias("shift"),
    )
    totals = stored(totals)
    sizes = [f"c{f}" for f in folds]
    large = stored(totals.where(F.col("cells") > listed).select(*by))
    window = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"{c}__before") for c in sizes]
    short = present.join(large, by, "left_anti").select("*", *before)
    long = present.join(large, by, "left_semi")
    long = running_totals(long, by, sizes, value_levels(F.col("value")), [F.col("value")])
    placed = short.unionByName(long).join(totals, by)

    def holds(f: int, rank: Column) -> Column:
        before, own = other("c{}__before", f), other("c{}", f)
        return F.max(F.when((before < rank) & (before + own >= rank), F.col("value")))

    facts = []
    away = F.col("value") - F.col("shift")
    for f in folds:
        n = other("p{}", f)
        facts += [
            holds(f, F.floor((n + 1) / 2)).alias(f"low{f}"), holds(f, F.floor((n + 2) / 2)).alias(f"high{f}"),
            F.sum(away * other("c{}", f)).alias(f"s{f}"), F.sum(away * away * other("c{}", f)).alias(f"q{f}"),
        ]
    found = totals.join(placed.groupBy(*by).agg(*facts), by, "left")
    rows = []
    for f in folds:
        n, seen = other("n{}", f), other("p{}", f)
        missing = n - seen
        median = F.coalesce((F.col(f"low{f}") + F.col(f"high{f}")) / 2, F.lit(0.0))
        shift = F.coalesce("shift", F.lit(0.0))
        # Missing cells count as copies of the median.
        gap = median - shift
        mean = (F.coalesce(f"s{f}", F.lit(0.0)) + missing * gap) / F.nullif(n, F.lit(0))
        square = (F.coalesce(f"q{f}", F.lit(0.0)) + missing * gap * gap) / F.nullif(n, F.lit(0))
        spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
        flat = spread <= 1e-12 * F.sqrt(F.greatest(square, F.lit(1e-300)))
        rows.append(
            F.struct(
                F.lit(f).alias(fold), n.alias("n_rows"), missing.alias("n_missing"), median.alias("median"),
                (missing > 0).alias("has_indicator"), (mean + shift).alias("imputed_mean"),
                F.when(flat, 1.0).otherwise(spread).alias("scale"),
            )
        )
    return found.select(*by, F.explode(F.array(*rows)).alias("e")).select(*by, "e.*")
