"""Writers. Nothing is overwritten: an existing target is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_or_fail(df: DataFrame) -> DataFrame:
    """Raise at write time where a top-level double is NaN or infinite."""
    checks: dict[str, Column] = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cell = F.col(field.name)
            bad = F.isnan(cell) | (F.abs(cell) == F.lit(float("inf")))
            fail = F.raise_error(F.lit(f"{field.name} is not finite")).cast(field.dataType)
            checks[field.name] = F.when(bad, fail).otherwise(cell)
    return df.withColumns(checks) if checks else df


def write_json(df: DataFrame, path: str) -> None:
    finite_or_fail(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """CSV with a header, sorted where an order is asked for."""
    ordered = df.orderBy(order_by) if order_by else df
    ordered.write.mode("errorifexists").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """One JSON document per line, as text."""
    artifacts.select("artifact").write.mode("errorifexists").text(path)
