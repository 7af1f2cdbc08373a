"""The labelled table all operators work on: many datasets in one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LabelledFrame:
    """Rows of many datasets with their feature roles.

    ``df`` holds the key columns (``dataset``, optionally ``family``), a ``row_id`` that is
    unique within a dataset, the features, and an integer target ``y``. Row identity is a
    column, so nothing depends on the order of rows.
    """

    df: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    keys: tuple[str, ...] = ("dataset",)
    target: str = "y"
    row_id: str = "row_id"

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("At least one feature column is needed.")
        names = [*self.keys, *self.features, self.target]
        if len(set(names)) != len(names):
            raise ValueError("Feature columns must be unique and apart from keys and target.")
        absent = sorted(set(names) - set(self.df.columns))
        if absent:
            raise ValueError(f"Missing columns: {absent}")

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def with_df(self, df: DataFrame, keys: tuple[str, ...] | None = None) -> LabelledFrame:
        return replace(self, df=df, keys=self.keys if keys is None else keys)


def infer_roles(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[tuple, tuple]:
    """Numeric columns and the rest, both in column order; booleans are categorical."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("Feature columns must be unique.")
    fields = [f for f in df.schema.fields if f.name not in exclude]
    if not fields:
        raise ValueError("At least one feature column is needed.")
    unusable = [
        f.name
        for f in fields
        if not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))
    ]
    if unusable:
        raise ValueError(f"Exclude or cast columns that are no features: {unusable}")
    numeric = tuple(f.name for f in fields if isinstance(f.dataType, T.NumericType))
    return numeric, tuple(f.name for f in fields if f.name not in numeric)


def role_rows(dataset: str, df: DataFrame) -> list[tuple[str, int, str, str]]:
    """(dataset, position, column, role) for each column of a schema."""
    rows = []
    for position, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, T.NumericType):
            role = "numeric"
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            role = "categorical"
        else:
            role = "unsupported"
        rows.append((dataset, position, field.name, role))
    return rows


def clean_numeric(column: Column) -> Column:
    """Cast to double and turn NaN into NULL: there is one kind of missing value."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def clean_categorical(df: DataFrame, name: str) -> Column:
    """Text form of a category; booleans become True/False."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(F.col(name).cast("string"))
    return F.col(name).cast("string")


def normalise(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> DataFrame:
    """Cast features to their roles in place, leaving all other columns alone."""
    casts = {name: clean_numeric(F.col(name)) for name in numeric}
    casts.update({name: clean_categorical(df, name) for name in categorical})
    return df.withColumns(casts)


def is_infinite(column: Column) -> Column:
    return F.abs(column) == F.lit(float("inf"))
