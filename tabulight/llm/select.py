"""The k-th largest value of a column, from counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CELLS = 1024
FEW = 1000


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """Value at place ``k`` (from 1) of the finite values in falling order; None if there are fewer or ``k`` is below 1.

    Each round counts the values in 1,024 cells of the interval that still holds the place, so a round sends at most that many
    counts to the driver; the last 1,000 values are then ordered. Equal values are no obstacle.
    """
    values = values.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    low, high, total = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or total < k:
        return None
    while low < high:
        inside = values.where(F.col("x").between(low, high))
        if total <= FEW:
            return sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]
        step = (high - low) / CELLS
        cell = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(CELLS - 1))
        rows = inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("x"), F.max("x")).collect()
        for _, n, first, last in sorted(rows, reverse=True):
            if k <= n:
                low, high, total = first, last, n
                break
            k -= n
    return low
