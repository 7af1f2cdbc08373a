"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairgauge.session import ensure_checkpoint_dir, stored

__all__ = ["ensure_checkpoint_dir", "lean", "partitions", "picked", "read", "stored", "takes_rows"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others cannot clash."""
    return df.select(*[df[f"`{there}`"].alias(own) for own, there in names.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def takes_rows(batches: Iterator) -> Iterator:
    """Batches that hold rows; Spark may send an empty one."""
    for batch in batches:
        if batch.num_rows:
            yield batch



#: Ways to empty what a worker process remembers between tasks of the same kind.
REMEMBERED: list[Callable[[], None]] = []


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches in a worker that remembers nothing and at its end returns freed memory.

    Spark keeps its Python workers between tasks, with the caches of earlier stages and all they freed.
    """

    def wrapped(batches: Iterator) -> Iterator:
        for forget in REMEMBERED:
            forget()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
