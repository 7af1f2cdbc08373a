"""Checks on the meta-table: which columns predict, what must be present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


def feature_columns(meta: DataFrame, extra: bool = False) -> list[str]:
    """Predictor columns: the ten descriptors, or with ``extra`` everything not reserved."""
    if extra:
        blocked = set(C.IDENTIFIERS) | set(C.OUTCOMES)
        names = [c for c in meta.columns if c not in blocked]
    else:
        names = [c for c in meta.columns if c in C.DESCRIPTORS]
    if not names:
        raise ValueError("No meta-feature columns found.")
    wrong = [c for c in names if not isinstance(meta.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"Meta-features must be numeric: {wrong}")
    return names


def require_columns(meta: DataFrame, needed: tuple[str, ...]) -> None:
    absent = sorted(set(needed) - set(meta.columns))
    if absent:
        raise ValueError(f"Meta-table is missing columns: {absent}")


def guard_training(meta: DataFrame, features: list[str], held_out: bool) -> None:
    """At least two rows, no missing values, and two families for held-out evaluation."""
    incomplete = F.lit(False)
    for name in [*features, C.GAP]:
        incomplete = incomplete | F.col(name).isNull()
    facts = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(incomplete).alias("incomplete"),
    ]
    if held_out:
        facts.append((F.min("family") != F.max("family")).alias("several"))
    row = meta.agg(*facts).first()
    if row["n"] < 2:
        raise ValueError("Need at least two datasets to fit a recommender.")
    if row["incomplete"]:
        raise ValueError("Meta-table contains missing values.")
    if held_out and not row["several"]:
        raise ValueError("Need at least two dataset families for held-out evaluation.")


def without_clinical(meta: DataFrame) -> DataFrame:
    """Rows that may be used for training when clinical datasets are set apart."""
    return meta.filter(~F.col("clinical"))
