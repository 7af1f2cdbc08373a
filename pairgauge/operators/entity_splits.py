"""Splits that keep all rows of an entity together: balanced blocks, and before and after a point in time.

Entities are counted once; places come from running totals over a few levels of hash prefixes or time units,
so no task holds all entities of a dataset, and rows join their entity's one result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_totals

SEED = 42


def _digest(seed: int, entity: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string")))


def entity_blocks(rows: DataFrame, k: int, seed: int = SEED, dataset: str = "dataset", entity: str = "entity") -> DataFrame:
    """(dataset, entity, n_rows, block): whole entities in ``k`` blocks of nearly equal size.

    Entities are laid end to end by their hash; an entity belongs to the block in which its middle lies, so
    the ends of a block move by less than the entity there. Rows without an entity form one entity together.
    """
    counted = rows.groupBy(dataset, entity).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = counted.withColumn("digest", F.coalesce(_digest(seed, entity), F.lit("")))
    levels = [F.substring("digest", 1, 3), F.substring("digest", 4, 3)]
    placed = running_totals(counted, [dataset], ["n_rows"], levels, [F.col("digest"), F.col(entity)])
    total = counted.groupBy(dataset).agg(F.sum("n_rows").alias("total"))
    middle = 2 * F.col("n_rows__before") + F.col("n_rows")
    # Twice the middle over twice the total, in whole numbers.
    block = F.expr(f"cast(middle * {k} div (2 * total) as int)")
    placed = placed.join(total, dataset).withColumn("middle", middle)
    return placed.select(dataset, entity, "n_rows", block.alias("block"))


def time_sides(
    rows: DataFrame, time: str, test_percent: int = 25, dataset: str = "dataset", entity: str = "entity"
) -> DataFrame:
    """(dataset, entity, n_rows, last, part): the entities that were seen last longest ago train.

    Entities are ordered by their last row; they train as long as all their rows fit into the share of rows
    that isn't for testing (rounded up). Each test entity thus ends no earlier than any training entity,
    no entity is on both sides, and the training part misses its size by less than one entity.
    """
    counted = rows.groupBy(dataset, entity).agg(F.count(F.lit(1)).alias("n_rows"), F.max(time).alias("last"))
    counted = counted.withColumns(
        {"digest": F.coalesce(_digest(SEED, entity), F.lit("")), "second": F.unix_timestamp(F.col("last").cast("timestamp"))}
    )
    levels = [F.floor(F.col("second") / 86400), F.col("second"), F.substring("digest", 1, 3)]
    placed = running_totals(counted, [dataset], ["n_rows"], levels, [F.col("digest"), F.col(entity)])
    total = counted.groupBy(dataset).agg(F.sum("n_rows").alias("total"))
    test = F.ceil(F.col("total") * test_percent / 100)
    fits = F.col("n_rows__before") + F.col("n_rows") <= F.col("total") - test
    placed = placed.join(total, dataset)
    return placed.select(dataset, entity, "n_rows", "last", F.when(fits, "train").otherwise("test").alias("part"))


def assigned(rows: DataFrame, sides: DataFrame, dataset: str = "dataset", entity: str = "entity") -> DataFrame:
    """Every row with the columns that ``sides`` has for its entity."""
    more = [c for c in sides.columns if c not in (dataset, entity, "n_rows", "last")]
    same = (F.col(f"r.{dataset}") == F.col(f"s.{dataset}")) & F.col(f"r.{entity}").eqNullSafe(F.col(f"s.{entity}"))
    return rows.alias("r").join(sides.alias("s"), same).select("r.*", *[F.col(f"s.{c}") for c in more])
