"""How far the recommender's regret could be chance: blocks of whole families drawn again and again.

Rows are summed per family once. A draw takes as many families as there are, with repetition; which one
stands at a place of a draw is a hash of (seed, draw, place), so reruns agree and no generator state exists.
Draws are a table of (draw, family, copies), which meets only the family sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.ranks import numbered
from ..session import stored

DRAWS = 2000
SEED = 42
MARGINS = (0.0, 0.005, 0.01, 0.02)
LEVEL = 0.95


def picked_families(families: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(draw, family, copies) from a table of distinct families."""
    named = stored(numbered(families.select("family"), [F.col("family")], "place"))
    n = named.count()
    spark = families.sparkSession
    slots = spark.range(draws).select(
        F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("slot")
    )
    text = F.concat_ws("|", F.lit(str(seed)), "draw", "slot")
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    picks = slots.select("draw", (hashed % F.lit(max(n, 1))).alias("place"))
    copies = picks.groupBy("draw", "place").agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(named, "place").select("draw", "family", "copies")


def _outcomes(predictions: DataFrame, low: str, high: str, margins: Sequence[float]) -> DataFrame:
    """Regret and hit of every prediction at every margin."""
    best = F.greatest(low, high)
    entries = F.array(*[F.lit(float(m)) for m in margins])
    each = predictions.select("family", low, high, "predicted_gap", F.explode(entries).alias("margin"))
    chosen = F.when(F.col("predicted_gap") > F.col("margin"), F.col(high)).otherwise(F.col(low))
    right = (F.col("predicted_gap") > F.col("margin")) == (F.col(high) > F.col(low))
    return each.select(
        "family", "margin", (best - chosen).alias("regret"), (best - F.col(low)).alias("low_regret"),
        right.cast("int").alias("hit"),
    )


def _interval(value: Column, name: str, level: float) -> list[Column]:
    tail = (1 - level) / 2
    return [
        F.percentile(value, tail).alias(f"{name}_low"),
        F.percentile(value, 1 - tail).alias(f"{name}_high"),
    ]


def family_bootstrap(
    predictions: DataFrame,
    low: str = C.SCORE_GBDT,
    high: str = C.SCORE_DNN,
    margins: Sequence[float] = MARGINS,
    draws: int = DRAWS,
    seed: int = SEED,
    level: float = LEVEL,
) -> DataFrame:
    """One row per margin: mean regret, accuracy, and the regret saved over always taking ``low``, with intervals.

    ``predictions`` has family, predicted_gap and the two scores, one row per dataset. All families are
    drawn alike, however many datasets they have; a draw's means weigh datasets by its copies.
    """
    sums = ["n", "regret", "saved", "hits"]
    per_family = stored(
        _outcomes(predictions, low, high, margins)
        .groupBy("family", "margin")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("regret").alias("regret"),
            F.sum(F.col("low_regret") - F.col("regret")).alias("saved"), F.sum("hit").alias("hits"),
        )
    )
    drawn = picked_families(per_family.select("family").distinct(), draws, seed)
    weighed = drawn.join(per_family, "family").groupBy("margin", "draw")
    totals = weighed.agg(*[F.sum(F.col("copies") * F.col(c)).alias(c) for c in sums])
    means = {c: F.col(k) / F.col("n") for c, k in (("mean_regret", "regret"), ("accuracy", "hits"), ("mean_saved", "saved"))}
    intervals = totals.groupBy("margin").agg(*[e for c, v in means.items() for e in _interval(v, c, level)])
    point = per_family.groupBy("margin").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_families")
    )
    point = point.select(
        "margin", F.col("n").alias("n_datasets"), "n_families", *[v.alias(c) for c, v in means.items()]
    )
    return point.join(intervals, "margin")
