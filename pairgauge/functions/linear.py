"""Small linear systems as column expressions, one system per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def solved(matrix: Column, size: int) -> Column:
    """The solution of ``size`` equations, rows of coefficients with the right side last.

    Gauss-Jordan without exchange of rows: the matrix must be positive definite, as a ridge's is.
    """

    def eliminate(m: Column, k: Column) -> Column:
        pivot = F.transform(m[k], lambda v: v / m[k][k])

        def cleared(row: Column, i: Column) -> Column:
            return F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda a, b: a - row[k] * b))

        return F.transform(m, cleared)

    steps = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(F.aggregate(steps, matrix, eliminate), lambda row: row[size])
