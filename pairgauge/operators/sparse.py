"""Sparse encoding: the level dictionary is a table, encoded rows are (row, index, value) entries.

The columns of the encoded matrix are numbered per dataset: numeric columns, then indicators of columns with
training gaps, then the levels of each categorical column in code-point order. Numbers come from one sorted,
range-partitioned table, so a column may have as many levels as rows. Rows meet the dictionary of their dataset
in one join, and cells of columns with very many levels in a second one; zeros are not stored, and names are kept once, in the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import LabelledFrame
from ..functions.ranks import numbered
from ..session import stored
from . import prep

#: A column with at most this many levels in a dataset is looked up in a map, one with more by a join.
LISTED_LEVELS = 1024


def dictionary(train: LabelledFrame) -> DataFrame:
    """(keys, kind, column, level, index, name, fill, mean, scale): one row per encoded column.

    ``kind`` is value, gap or level; ``fill`` replaces a missing number. Mean and scale belong to numbers and
    indicators only.
    """
    keys = list(train.keys)
    none = F.lit(None).cast("double")
    parts = []
    if train.numeric:
        order = F.array(*[F.lit(c) for c in train.numeric])
        stats = prep.numeric_statistics(train).withColumn("place", F.array_position(order, F.col("column")))
        base = [*[F.col(k) for k in keys], F.col("column"), F.lit(None).cast("string").alias("level"), F.col("place")]
        parts.append(
            stats.select(
                F.lit(0).alias("block"), F.lit("value").alias("kind"), *base, F.col("column").alias("name"),
                F.col("median").alias("fill"), F.col("imputed_mean").alias("mean"), F.col("scale").alias("scale"),
            )
        )
        parts.append(
            stats.where("has_indicator").select(
                F.lit(1).alias("block"), F.lit("gap").alias("kind"), *base,
                F.concat(F.lit(prep.INDICATOR_PREFIX), F.col("column")).alias("name"), none.alias("fill"),
                F.col("indicator_mean").alias("mean"), F.col("indicator_scale").alias("scale"),
            )
        )
    if train.categorical:
        order = F.array(*[F.lit(c) for c in train.categorical])
        levels = prep.category_levels(train)
        parts.append(
            levels.select(
                F.lit(2).alias("block"), F.lit("level").alias("kind"), *keys, "column", "level",
                F.array_position(order, F.col("column")).alias("place"),
                F.concat("column", F.lit("_"), "level").alias("name"),
                none.alias("fill"), none.alias("mean"), none.alias("scale"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    placed = numbered(whole, [*[F.col(k) for k in keys], F.col("block"), F.col("place"), F.col("level")])
    first = placed.groupBy(*keys).agg(F.min("number").alias("first"))
    return stored(
        placed.join(first, keys).select(
            *keys, "kind", "column", "level", (F.col("number") - F.col("first")).alias("index"),
            "name", "fill", "mean", "scale",
        )
    )


def _packed(rows: LabelledFrame, known: DataFrame, long: DataFrame) -> DataFrame:
    """One row per dataset: a struct per number and indicator, a map from level to index per other column.

    Columns in ``long`` have too many levels for a map and get none.
    """
    keys = list(rows.keys)
    of = lambda kind, c: (F.col("kind") == kind) & (F.col("column") == c)
    facts = F.struct("index", "fill", "mean", "scale")
    levels = F.struct("level", "index")
    found = [F.max(F.when(of(kind, c), facts)).alias(f"__{kind}_{c}") for c in rows.numeric for kind in ("value", "gap")]
    found += [F.map_from_entries(F.collect_list(F.when(of("level", c), levels))).alias(f"__level_{c}") for c in rows.categorical]
    short = known.join(long, [*keys, "column"], "left_anti")
    return short.groupBy(*keys).agg(*found)


def entries(rows: LabelledFrame, known: DataFrame, scaled: bool = False, listed: int = LISTED_LEVELS) -> DataFrame:
    """(keys, row_id, index, value) of every encoded cell that isn't zero.

    A level that training rows didn't have has no entry; a missing number is filled, and has an indicator
    only where training had gaps. Scaling touches numbers and indicators, which are dense once scaled.
    A row meets its dataset's dictionary once; only columns of more than ``listed`` levels are joined by cell.
    """
    prep.check_columns(rows.df.columns, rows.features)
    keys = list(rows.keys)
    levels = known.where("kind = 'level'")
    long = levels.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > listed)
    long = stored(long.select(*keys, "column"))
    cells: list[Column] = []

    def cell(entry: Column, value: Column) -> Column:
        value = F.coalesce(value, entry["fill"])
        if scaled:
            value = (value - entry["mean"]) / entry["scale"]
        return F.when(entry.isNotNull(), F.struct(entry["index"].alias("index"), value.alias("value")))

    for c in rows.numeric:
        cells.append(cell(F.col(f"__value_{c}"), F.col(c).cast("double")))
        gap = cell(F.col(f"__gap_{c}"), F.col(c).isNull().cast("double"))
        cells.append(gap if scaled else F.when(F.col(c).isNull(), gap))
    for c in rows.categorical:
        index = F.try_element_at(F.col(f"__level_{c}"), prep.filled_level(c))
        cells.append(F.when(index.isNotNull(), F.struct(index.alias("index"), F.lit(1.0).alias("value"))))
    present = F.explode(F.filter(F.array(*cells), lambda e: e.isNotNull())).alias("e")
    narrow = rows.df.select(*keys, rows.row_id, *rows.features)
    found = narrow.join(_packed(rows, known, long), keys).select(*keys, rows.row_id, present).select(*keys, rows.row_id, "e.*")
    if rows.categorical:
        entry = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), prep.filled_level(c).alias("level")) for c in rows.categorical]))
        split = narrow.select(*keys, rows.row_id, entry.alias("e")).select(*keys, rows.row_id, "e.*")
        split = split.join(long, [*keys, "column"], "left_semi")
        split = split.join(levels.join(long, [*keys, "column"], "left_semi").select(*keys, "column", "level", "index"), [*keys, "column", "level"])
        found = found.union(split.select(*keys, rows.row_id, "index", F.lit(1.0).alias("value")))
    return found.where("value <> 0")


def vectors(found: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("dataset",), row_id: str = "row_id") -> DataFrame:
    """(keys, row_id, size, indices, values): one sparse row each, indices ascending.

    A row has at most as many entries as its table has columns, plus the indicators.
    """
    cell = F.array_sort(F.collect_list(F.struct("index", "value")))
    size = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    packed = found.groupBy(*keys, row_id).agg(cell.alias("cells")).join(size, list(keys))
    return packed.select(*keys, row_id, "size", F.col("cells.index").alias("indices"), F.col("cells.value").alias("values"))
