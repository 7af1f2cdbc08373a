"""Exact order statistics that never put a whole group into one task.

``exact_medians`` selects instead of sorting: a mergeable sketch brackets the middle ranks, a
second scan keeps only the values inside the bracket (a sliver of a large group, everything of
a tiny one) plus a count of those below, and only that sliver is ordered. The result is exact;
a bracket that missed the middle would raise rather than return a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sketch accuracy: rank error below n / SKETCH_ACCURACY.
SKETCH_ACCURACY = 20_000


def column_moments(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Per key: rows, and a struct per column with counts, mean, variance and median bracket."""
    margin = 4.0 / accuracy
    bracket = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
    structs = [
        F.struct(
            F.count(F.col(c)).alias("present"),
            F.avg(c).alias("mean"),
            F.var_pop(c).alias("variance"),
            F.percentile_approx(c, bracket, accuracy).alias("bracket"),
        ).alias(c)
        for c in columns
    ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *structs)


def exact_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """(keys, column, n_rows, present, mean, variance, median) for each numeric column.

    Missing values are ignored; a column without values has a NULL median.
    """
    keys = list(keys)
    moments = column_moments(df, keys, columns, accuracy)
    brackets = moments.select(
        *keys,
        *[F.col(f"{c}.bracket")[0].alias(f"{c}__low") for c in columns],
        *[F.col(f"{c}.bracket")[1].alias(f"{c}__high") for c in columns],
    )
    # value NULL marks "below the bracket"; those rows collapse in the map-side combine.
    candidates = F.array(
        *[
            F.when(
                F.col(c) <= F.col(f"{c}__high"),
                F.struct(
                    F.lit(c).alias("column"),
                    F.when(F.col(c) >= F.col(f"{c}__low"), F.col(c)).alias("value"),
                ),
            )
            for c in columns
        ]
    )
    kept = (
        df.select(*keys, *columns)
        .join(brackets, keys)
        .select(*keys, F.explode(F.filter(candidates, lambda e: e.isNotNull())).alias("e"))
        .groupBy(*keys, "e.column", "e.value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ordered = (
        Window.partitionBy(*keys, "column")
        .orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    facts = moments.select(
        *keys,
        "n_rows",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"{c}.present").alias("present"),
                        F.col(f"{c}.mean").alias("mean"),
                        F.col(f"{c}.variance").alias("variance"),
                    )
                    for c in columns
                ]
            )
        ).alias("f"),
    ).select(*keys, "n_rows", "f.*")
    upto = F.col("upto")
    before = upto - F.col("copies")
    lower_rank = F.expr("(present + 1) div 2")
    upper_rank = F.expr("(present + 2) div 2")
    holds_lower = (before < lower_rank) & (upto >= lower_rank)
    holds_upper = (before < upper_rank) & (upto >= upper_rank)
    middles = (
        kept.withColumn("upto", F.sum("copies").over(ordered))
        .join(facts, [*keys, "column"])
        .groupBy(*keys, "column")
        .agg(
            F.max(F.when(holds_lower, F.col("value"))).alias("lower"),
            F.max(F.when(holds_upper, F.col("value"))).alias("upper"),
        )
    )
    found = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    return facts.join(middles, [*keys, "column"], "left").select(
        *keys,
        "column",
        "n_rows",
        "present",
        "mean",
        "variance",
        F.when(F.col("present") == 0, F.lit(None).cast("double"))
        .when(found, (F.col("lower") + F.col("upper")) / 2)
        .otherwise(F.raise_error(F.lit("median bracket missed the middle rank")))
        .alias("median"),
    )
