"""Train once, recommend for tables that were not there: fitted models as rows of a table.

``train`` turns meta-rows into a model table with one row per group of ``by`` (one group without it): the
predictor columns, their centres and scales, coefficients, or tree nodes. It can be written like any other
table. ``predict`` joins it to unseen meta-rows and needs no outcome there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.linear import solved
from ..session import stored
from . import meta as M
from . import trees as T
from .scoring import is_finite
from .trials import recommendation

KINDS = ("dummy_mean", "ridge", "decision_tree", "random_forest")
RIDGE_ALPHA = 1.0
ONLY = "all"
_NODES = "array<array<struct<feature:int,threshold:double,value:double>>>"


def _checked(meta: DataFrame, features: Sequence[str], target: str, by: str | None) -> DataFrame:
    """Training rows with their model's name and why the model cannot be fitted, if so."""
    M.require_columns(meta, tuple({"dataset", target, *features, *([by] if by else [])}))
    if "clinical" in meta.columns:
        meta = M.without_clinical(meta)
    name = F.col(by).cast("string") if by else F.when(F.col("dataset").isNotNull(), ONLY).otherwise(ONLY)
    return meta.select(
        name.alias("model"), "dataset", F.col(target).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(c) for c in features],
    )


def _ridge(rows: DataFrame, features: Sequence[str], alpha: float) -> DataFrame:
    """(model, centers, scales, weights): two scans, moments first, then products of centred columns."""
    p = len(features)
    moments = rows.groupBy("model").agg(
        F.avg("y").alias("mean_y"),
        F.array(*[F.avg(c) for c in features]).alias("centers"),
        # A column that only rounding moves is constant; constant columns are divided by one.
        F.array(
            *[
                F.when(F.stddev_pop(c) > 1e-12 * F.greatest(F.max(F.abs(F.col(c))), F.lit(1e-300)), F.stddev_pop(c)).otherwise(1.0)
                for c in features
            ]
        ).alias("scales"),
    )
    joined = rows.join(moments, "model").select(
        "model", "centers", "scales", (F.col("y") - F.col("mean_y")).alias("y"),
        *[((F.col(c) - F.col("centers")[i]) / F.col("scales")[i]).alias(f"z{i}") for i, c in enumerate(features)],
    )
    sums = {f"s{i}_{j}": F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(p) for j in range(i, p)}
    sums |= {f"t{i}": F.sum(F.col(f"z{i}") * F.col("y")) for i in range(p)}
    summed = joined.groupBy("model").agg(
        F.first("centers").alias("centers"), F.first("scales").alias("scales"),
        *[v.alias(k) for k, v in sums.items()],
    )

    def cell(i: int, j: int) -> Column:
        own = F.col(f"s{min(i, j)}_{max(i, j)}")
        return own + F.lit(float(alpha)) if i == j else own

    matrix = F.array(*[F.array(*[cell(i, j) for j in range(p)], F.col(f"t{i}")) for i in range(p)])
    return summed.select("model", "centers", "scales", solved(matrix, p).alias("weights"))


def train(
    meta: DataFrame,
    kind: str = "ridge",
    features: Sequence[str] | None = None,
    target: str = C.GAP,
    by: str | None = None,
    extra: bool = False,
    alpha: float = RIDGE_ALPHA,
    seed: int = 42,
) -> DataFrame:
    """(model, kind, status, n_rows, features, intercept, centers, scales, weights, depth, trees).

    Without ``by`` there is one model, and too few rows or missing values raise. With it, a group that
    cannot be fitted gets a row whose ``status`` says why; its parameters are null. ``extra`` takes every
    numeric column that is neither identifier nor outcome as a predictor, else the ten descriptors do.
    Rows marked clinical never train.
    """
    if kind not in KINDS:
        raise ValueError(f"Unknown recommender model {kind!r}.")
    names = list(features) if features else [c for c in M.feature_columns(meta, extra) if c not in (target, by)]
    rows = _checked(meta, names, target, by)
    gap = reduce(or_, [F.col(c).isNull() | F.isnan(c) for c in [*names, "y"]])
    facts = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(gap).alias("gaps"), F.avg("y").alias("intercept")
    )
    status = (
        F.when(F.col("n_rows") < 2, "too_few_rows").when(F.col("gaps") > 0, "missing_values").otherwise("ok")
    )
    facts = stored(facts.select("model", status.alias("status"), "n_rows", "intercept"))
    if by is None:
        only = facts.first()
        if only is None or only["status"] == "too_few_rows":
            raise ValueError("Need at least two datasets to fit a recommender.")
        if only["status"] != "ok":
            raise ValueError("Meta-table contains missing values.")
    good = facts.where("status = 'ok'").select("model")
    empty = {
        "centers": F.lit(None).cast("array<double>"), "scales": F.lit(None).cast("array<double>"),
        "weights": F.lit(None).cast("array<double>"), "depth": F.lit(None).cast("int"),
        "trees": F.lit(None).cast(_NODES),
    }
    usable = rows.join(good, "model")
    if kind == "dummy_mean":
        fitted = good.select("model", *[v.alias(k) for k, v in empty.items()])
    elif kind == "ridge":
        found = _ridge(usable, names, alpha)
        fitted = found.select("model", "centers", "scales", "weights", empty["depth"].alias("depth"), empty["trees"].alias("trees"))
    else:
        fitted = _forest(usable, names, kind, seed, empty)
    return facts.join(fitted, "model", "left").select(
        "model", F.lit(kind).alias("kind"), "status", "n_rows",
        F.array(*[F.lit(c) for c in names]).alias("features"),
        F.when(F.col("status") == "ok", F.col("intercept")).alias("intercept"),
        "centers", "scales", "weights", "depth", "trees",
    )


def _forest(rows: DataFrame, names: Sequence[str], kind: str, seed: int, empty: dict) -> DataFrame:
    shape = T.SHAPES[kind]
    shape = T.Shape(shape.trees, shape.depth, shape.bootstrap, seed)
    nodes = T.grow_groups(rows.withColumnRenamed("model", "group"), names, shape)
    packed = T.packed(nodes, shape.depth).withColumnRenamed("group", "model")
    return packed.select(
        "model", *[empty[c].alias(c) for c in ("centers", "scales", "weights")],
        F.lit(shape.depth).alias("depth"), F.col("trees").cast(_NODES).alias("trees"),
    )


def predict(
    models: DataFrame,
    meta: DataFrame,
    features: Sequence[str],
    by: str | None = None,
    margin: float = C.MARGIN,
    labels: tuple[str, str] = ("GBDT", "DNN"),
) -> DataFrame:
    """Meta-rows with ``model``, ``predicted_gap`` and ``recommendation``.

    ``features`` are the columns the models were trained on, in their order; a model with others raises, and
    so does a prediction that isn't finite. A row without a usable model has a null prediction.
    """
    taken = {"model", "predicted_gap", "recommendation"} & set(meta.columns)
    if taken:
        raise ValueError(f"Columns of the prediction are taken: {sorted(taken)}")
    M.require_columns(meta, tuple(features))
    # A column, not a literal, or the join would have no key.
    name = F.col(by).cast("string") if by else F.when(F.col(meta.columns[0]).isNotNull(), ONLY).otherwise(ONLY)
    keyed = meta.withColumn("model", name)
    values = F.array(*[F.col(f"m.{c}").cast("double") for c in features])
    joined = keyed.alias("m").join(models.alias("f"), "model", "left")
    same = F.col("f.features") == F.array(*[F.lit(c) for c in features])
    linear = F.aggregate(
        F.arrays_zip(
            F.col("f.weights").alias("w"), F.col("f.centers").alias("c"),
            F.col("f.scales").alias("s"), values.alias("x"),
        ),
        F.col("f.intercept"),
        lambda total, e: total + e["w"] * (e["x"] - e["c"]) / e["s"],
    )
    by_kind = (
        F.when(F.col("f.trees").isNotNull(), T.walked(F.col("f.trees"), values, F.col("f.depth")))
        .when(F.col("f.weights").isNotNull(), linear)
        .otherwise(F.col("f.intercept"))
    )
    bad = lambda text: F.raise_error(F.lit(text)).cast("double")
    gap = (
        F.when(F.col("f.status").isNull() | (F.col("f.status") != "ok"), F.lit(None).cast("double"))
        .when(~same, bad("The model was trained on other columns."))
        .when(is_finite(by_kind), by_kind)
        .otherwise(bad("Recommender produced a non-finite prediction."))
    )
    out = joined.select("m.*", gap.alias("predicted_gap"))
    low, high = labels
    choice = F.when(F.col("predicted_gap").isNotNull(), recommendation(F.col("predicted_gap"), margin))
    named = F.when(choice == "DNN", high).when(choice == "GBDT", low)
    return out.withColumn("recommendation", named)
