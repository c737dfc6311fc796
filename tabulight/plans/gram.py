"""Co-moments of many columns, in one scan at any width.

Each task centres its Arrow batches, multiplies them as matrices and merges them into means and centred
sums (the parallel form of Chan, Golub and LeVeque), so no shift has to be known beforehand; it leaves one
row per pair of columns. A missing value counts in no sum of its pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabulight.plans.profile import literal_rows

#: A row of up to 100 columns is compiled as one method, which the JVM leaves unoptimised if it is long; a wider one is compiled in parts.
SHORT_ROW, WIDE_ROW = 25, 101
FIELDS = ("n", "mx", "my", "xx", "yy", "xy", "lx", "hx", "ly", "hy")


def _moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the rows in which both columns of a pair have a value: their number, means of the first, centred sums of its squares and of products;
    then the smallest and largest value of each column. Infinite values are seen by the last two only."""
    known = ~np.isnan(x)
    low, high = np.where(known, x, np.inf).min(axis=0), np.where(known, x, -np.inf).max(axis=0)
    there = np.isfinite(x)
    gaps = np.flatnonzero(~there.all(axis=0))
    here = there.astype(np.float64)
    count = here.sum(axis=0)
    y = np.where(there, x, 0.0)
    middle = y.sum(axis=0) / np.maximum(count, 1)
    y -= middle
    y *= here
    square = y * y
    wide = np.ones((1, x.shape[1]))
    n, s, q = count[:, None] * wide, y.sum(axis=0)[:, None] * wide, square.sum(axis=0)[:, None] * wide
    if len(gaps):
        some = here[:, gaps]
        n[:, gaps], s[:, gaps], q[:, gaps] = here.T @ some, y.T @ some, square.T @ some
    off = s / np.maximum(n, 1)
    return n, middle[:, None] + off, q - off * s, y.T @ y - off * s.T, low, high


def _merged(one: tuple, two: tuple) -> tuple[np.ndarray, ...]:
    n = one[0] + two[0]
    part = two[0] / np.maximum(n, 1)
    step = np.where(two[0] > 0, two[1] - one[1], 0.0)
    weight = one[0] * part
    return (n, one[1] + step * part, one[2] + two[2] + step * step * weight, one[3] + two[3] + step * step.T * weight,
            np.minimum(one[4], two[4]), np.maximum(one[5], two[5]))


def pair_sums(values: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, n, xx, yy, xy, lx, hx, ly, hy) for pairs of places of double columns: over the rows in which both have a value, how many there
    are and the centred sums of x*x, y*y and x*y; then the smallest and largest x and y of all rows (lx > hx without any). All pairs have a row."""
    a, b = (np.array(side, dtype=np.int32) for side in zip(*pairs))
    width = len(values.columns)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]])
            with np.errstate(over="ignore", invalid="ignore"):
                found = _moments(x)
                total = found if total is None else _merged(total, found)
        if total is None:
            return
        n, mean, square, product, low, high = total
        rows = (n[a, b], mean[a, b], mean[b, a], square[a, b], square[b, a], product[a, b], low[a], high[a], low[b], high[b])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, *rows)], names=["a", "b", *FIELDS])

    if SHORT_ROW < width < WIDE_ROW:
        values = values.selectExpr("*", *[f"true as `fill{i}`" for i in range(WIDE_ROW - width)])
    schema = "a int, b int, " + ", ".join(f"{c} double" for c in FIELDS)
    none = literal_rows(values, [(i, j) for i, j in pairs], "a int, b int").selectExpr("a", "b", *[
        f"double('{'inf' if c in ('lx', 'ly') else '-inf' if c in ('hx', 'hy') else 0}') as {c}" for c in FIELDS])
    parts = values.mapInArrow(summed, schema).unionByName(none)
    pair = W.partitionBy("a", "b")                      # a row of each task: their common means first, then the sums about them
    centred = parts.select("*", *[F.try_divide(F.sum(F.col("n") * F.col(m)).over(pair), F.sum("n").over(pair)).alias(c) for m, c in (("mx", "cx"), ("my", "cy"))])
    about = lambda s, x, y: F.expr(f"sum({s} + if(n > 0, n * (m{x} - c{x}) * (m{y} - c{y}), 0D))")
    return centred.groupBy("a", "b").agg(
        F.sum("n").alias("n"), about("xx", "x", "x").alias("xx"), about("yy", "y", "y").alias("yy"), about("xy", "x", "y").alias("xy"),
        *[F.min(c).alias(c) for c in ("lx", "ly")], *[F.max(c).alias(c) for c in ("hx", "hy")])
