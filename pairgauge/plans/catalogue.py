"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attempts, extended, oracle, queries, transfer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **queries.QUERIES,
    **transfer.QUERIES,
    **extended.QUERIES,
    **attempts.QUERIES,
}


def statements() -> dict[str, str]:
    parts = (oracle, transfer, extended, attempts)
    return {name: text for part in parts for name, text in part.statements().items()}
