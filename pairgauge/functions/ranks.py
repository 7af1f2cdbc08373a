"""Row numbers over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """``name`` counts from 0 in the given order.

    The order is range-partitioned and stored; a row's number is its place in its partition plus the
    sizes of the partitions before, of which there is one row each.
    """
    place = F.monotonically_increasing_id()
    held = stored(
        df.orderBy(*order).select(
            "*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__at")
        )
    )
    before = F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    parts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered_ = held.join(parts, "__part").withColumn(name, F.col("__before") + F.col("__at"))
    return numbered_.select(*df.columns, name)


def running_totals(
    df: DataFrame, keys: Sequence[str], sizes: Sequence[str], levels: Sequence[Column], order: Sequence[Column]
) -> DataFrame:
    """``<size>__before`` for each size: its sum over the rows of the key that come earlier.

    ``levels`` are columns that grow with the order, coarse to fine. Sums of a level are added up within
    one value of the level above, so a task holds the values of one level, never all rows of a key.
    """
    names = [f"__level{k}" for k in range(len(levels))]
    leveled = df.select("*", *[c.alias(n) for c, n in zip(levels, names, strict=True)])

    def before(within: list[str], by: list, size: str) -> Column:
        window = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(window), F.lit(0))

    parents = [*keys, *names]
    out = leveled.select("*", *[before(parents, list(order), s).alias(f"{s}__before") for s in sizes])
    for depth in range(len(names), 0, -1):
        own = [*keys, *names[:depth]]
        above, here = [*keys, *names[: depth - 1]], names[depth - 1]
        summed = leveled.groupBy(*own).agg(*[F.sum(s).alias(s) for s in sizes])
        added = summed.select(*own, *[before(above, [F.col(here)], s).alias(f"{s}__add") for s in sizes])
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in own]
        condition = same[0]
        for part in same[1:]:
            condition = condition & part
        out = out.alias("o").join(added.alias("a"), condition).select(
            "o.*", *[F.col(f"a.{s}__add") for s in sizes]
        )
        out = out.withColumns({f"{s}__before": F.col(f"{s}__before") + F.col(f"{s}__add") for s in sizes})
        out = out.drop(*[f"{s}__add" for s in sizes])
    return out.drop(*names)


def value_levels(value: Column) -> list[Column]:
    """Two levels for doubles: sign and exponent, then the leading twelve bits of the mantissa."""
    exponent = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(value))).cast("int"))
    sign = F.signum(value).cast("int")
    return [sign * (exponent + 1200), F.floor(value / F.pow(F.lit(2.0), exponent) * 4096)]
