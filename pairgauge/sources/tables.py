"""Loading landed tables and turning them into labelled frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..frame import LabelledFrame, infer_roles, normalise

META_SCHEMA = ", ".join(
    [
        "dataset string, openml_id bigint, version bigint, family string, clinical boolean",
        *[f"{d} double" for d in C.DESCRIPTORS],
        f"{C.SCORE_GBDT} double, {C.SCORE_DNN} double, {C.GAP} double",
        "actual_best_pipeline string, near_tie_within_margin boolean",
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_meta_csv(spark: SparkSession, path: str) -> DataFrame:
    """A meta-table written by ``sinks.write_csv``; extra numeric descriptors are dropped."""
    return read_csv(spark, path, META_SCHEMA)


def binary_target(label: Column, positive: str) -> Column:
    """1 for the positive label, 0 for the other; missing stays missing."""
    return (label == F.lit(positive)).cast("int")


def labelled(
    df: DataFrame,
    target: str,
    positive: str | None = None,
    dataset: Column | str = "dataset",
    row_id: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> LabelledFrame:
    """A labelled frame from one raw table, roles inferred from its schema.

    ``row_id`` names the columns that identify a row; splits need them, profiles do not.
    Excluded and identifying columns are no features. ``positive`` encodes a text target;
    without it the target must already be 0/1.
    """
    if target not in df.columns:
        raise ValueError(f"Target column {target!r} does not exist.")
    key = F.lit(dataset) if isinstance(dataset, str) else dataset
    skipped = {target, *row_id, *exclude}
    numeric, categorical = infer_roles(df, tuple(skipped))
    y = F.col(target).cast("int") if positive is None else binary_target(
        F.col(target).cast("string"), positive
    )
    identity = [F.concat_ws("-", *[F.col(c).cast("string") for c in row_id]).alias("row_id")]
    clean = normalise(df, numeric, categorical)
    framed = clean.select(
        key.alias("dataset"), *(identity if row_id else []), *numeric, *categorical, y.alias("y")
    )
    return LabelledFrame(framed, numeric, categorical)


def union_datasets(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of many datasets in one DataFrame, columns matched by name."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged
