"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one map on one executor, which does
not hold for a large column. Here each wanted rank is fenced in: a small mergeable sketch of
the values between the fences proposes two values near the rank, and one scan counts exactly
how many rows lie below each proposal and how many equal it. Either the rank falls on a
proposal and is known, or the proposal becomes the new fence. Fences are no part of what they
enclose, so a value that fills half a column is passed in one step. When ``FENCE_ROWS`` rows or
fewer are left between the fences, they are grouped by value and ordered.

The sketch steers how fast the fences close, never the result. What reaches the driver is one
row of counts per scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabulight.functions.columns import double_sql

SMALL_ROWS = 20_000      # below this a column is ordered as it is
FENCE_ROWS = 1_000_000   # a fenced part may hold this many rows when it is ordered
SKETCH_SIZE = 4096
MARGIN = 0.004           # rank share kept on each side of the proposed fences
STEP = 0.0005            # ranks closer than this share look for fences at the same places
SKETCH_GROUPS = 64       # sketches are merged in two steps, so no task merges all of them
COLUMNS_PER_SCAN = 24


@dataclass(frozen=True)
class Slot:
    """A wanted rank of one column and the values strictly between its fences; None is no fence."""

    column: str
    rank: int
    below: int           # rows up to the lower fence, it included
    inside: int          # rows strictly between the fences
    low: float | None = None
    high: float | None = None
    value: float | None = None      # once it is known

    @property
    def fence(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high

    def holds(self, values: dict[str, str]) -> str:
        v = values[self.column]
        tests = [f"{v} is not null"] + [f"{v} {sign} {double_sql(f)}" for sign, f in ((">", self.low), ("<", self.high)) if f is not None]
        return "(" + " and ".join(tests) + ")"

    @property
    def shares(self) -> list[float]:
        """Where to look between the fences: neighbouring ranks look at the same places."""
        at = (self.rank - self.below) // (STEP * self.inside) * STEP
        return [at - MARGIN, at + STEP + MARGIN]


def _sketch(df: DataFrame, wanted: dict[str, str], extra: dict[str, str] = {}) -> DataFrame:
    """One row with a merged sketch per name; ``extra`` are count/min/max asked in the same scan."""
    again = {"count": "sum", "min": "min", "max": "max"}
    parts = df.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("part")).agg(
        *[F.expr(f"kll_sketch_agg_double({e}, {SKETCH_SIZE}) as {n}") for n, e in wanted.items()],
        *[F.expr(f"{e} as {n}") for n, e in extra.items()])
    return parts.agg(
        *[F.expr(f"kll_merge_agg_double({n}) as {n}") for n in wanted],
        *[F.expr(f"{again[e.split('(')[0]]}({n}) as {n}") for n, e in extra.items()])


def _read_off(sketch: str, shares: list[float]) -> str:
    inside = ", ".join(double_sql(min(1.0, max(0.0, x))) for x in shares)
    return f"case when kll_sketch_get_n_double({sketch}) > 0 then kll_sketch_get_quantile_double({sketch}, array({inside})) end"


def _proposed(df: DataFrame, slots: list[Slot], values: dict[str, str]) -> list[list[float]]:
    """Two values around each slot's rank, from a sketch of the rows between its fences."""
    fences = {s.fence: s for s in slots}
    name = {fence: f"s{i}" for i, fence in enumerate(fences)}
    sketches = _sketch(df, {
        name[f]: f"case when {s.holds(values)} then {values[s.column]} end" for f, s in fences.items()})
    row = sketches.selectExpr(*[_read_off(name[s.fence], s.shares) + f" as f{i}" for i, s in enumerate(slots)]).first()
    return [list(row[i]) for i in range(len(slots))]


def _counts(df: DataFrame, places: dict[str, list[float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """How many values of a column lie below each of its places, and how many below or at it; in one scan, by Arrow batches.

    Hundreds of counts would be one method of generated code that the JVM leaves unoptimised.
    """
    columns = list(places)
    edges = [np.array(places[n]) for n in columns]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(e)), np.int64) for e in edges]
        for batch in batches:
            for found, e, column in zip(total, edges, batch.columns):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                for row, side in zip(found, ("right", "left")):     # edges up to the value; edges below it
                    row += np.cumsum(np.bincount(np.searchsorted(e, x, side), minlength=len(e) + 1))[:-1]
        at = [(c, i, *found[:, i]) for c, found in enumerate(total) for i in range(found.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*at)], names=["c", "i", "less", "most"])

    rows = df.select(*columns).mapInArrow(counted, "c bigint, i bigint, less bigint, most bigint").groupBy("c", "i").agg(
        F.sum("less").alias("less"), F.sum("most").alias("most")).collect()
    return {(columns[r["c"]], float(edges[r["c"]][r["i"]])): (r["less"], r["most"]) for r in rows}


def _close_in(df: DataFrame, slots: list[Slot], values: dict[str, str], proposed: list[list[float]]) -> list[Slot]:
    """Each slot with its value, if that is one of the proposed, or else with closer fences."""
    wanted: dict[str, set[float]] = {}
    for s, fences in zip(slots, proposed):
        wanted.setdefault(values[s.column], set()).update(fences)
    counts = _counts(df, {name: sorted(fences) for name, fences in wanted.items()})
    closed = []
    for s, fences in zip(slots, proposed):
        low, below, high, upto, value = s.low, s.below, s.high, s.below + s.inside, None
        for f in fences:
            less, most = counts[values[s.column], f]
            if less <= s.rank < most:
                value = f
            elif s.rank < less and less <= upto:
                high, upto = f, less
            elif s.rank >= most and most >= below:
                low, below = f, most
        closed.append(Slot(s.column, s.rank, below, upto - below, low, high, value))
    return closed


def _inside(df: DataFrame, fences: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(slot, value): the values strictly between fences (column, low, high), with the fences' place in the list."""
    columns = list(dict.fromkeys(c for c, _, _ in fences))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {c: a.drop_null().to_numpy(zero_copy_only=False) for c, a in zip(columns, batch.columns)}
            for slot, (c, low, high) in enumerate(fences):
                x = arrays[c]
                keep = np.ones(len(x), bool)
                if low is not None:
                    keep &= x > low
                if high is not None:
                    keep &= x < high
                x = x[keep] + 0.0                                   # -0.0 is 0.0
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), slot, np.int32)), pa.array(x)], names=["slot", "value"])

    return df.select(*columns).mapInArrow(between, "slot int, value double")


def _order(df: DataFrame, slots: list[Slot], values: dict[str, str]) -> dict[Slot, float]:
    """Order the rows between the fences and read off the ranks."""
    fences = {s.fence: s for s in slots}
    place = {fence: i for i, fence in enumerate(fences)}
    counted = _inside(df, [(values[c], low, high) for c, low, high in fences]).groupBy("slot", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("slot").orderBy("value"))
    rows = counted.withColumn("upto", upto).groupBy("slot").agg(*[
        F.min(F.when((F.col("slot") == place[s.fence]) & (F.col("upto") > s.rank - s.below), F.col("value"))).alias(f"v{i}")
        for i, s in enumerate(slots)]).collect()
    found = {r["slot"]: r for r in rows}
    return {s: found[place[s.fence]][f"v{i}"] for i, s in enumerate(slots)}


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], as_number: Callable[[str], str],
    small_rows: int = SMALL_ROWS, fence_rows: int = FENCE_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column; None for a column without numbers."""
    result: dict[str, list[float | None]] = {}
    for start in range(0, len(columns), COLUMNS_PER_SCAN):
        batch = columns[start:start + COLUMNS_PER_SCAN]
        result.update(_quantiles(df, batch, probs, as_number, small_rows, fence_rows))
    return result


def _quantiles(df, columns, probs, as_number, small_rows, fence_rows):
    numbers = df.selectExpr(*[f"{as_number(c)} as v{i}" for i, c in enumerate(columns)])
    values = {c: f"v{i}" for i, c in enumerate(columns)}
    shares = [x for p in probs for x in (p - MARGIN, p + MARGIN)]
    sizes = _sketch(
        numbers, {f"s{i}": v for i, v in enumerate(values.values())}, {f"n{i}": f"count({v})" for i, v in enumerate(values.values())},
    ).selectExpr("*", *[f"{_read_off(f's{i}', shares)} as f{i}" for i in range(len(columns))]).drop(
        *[f"s{i}" for i in range(len(columns))]).first()
    slots: dict[tuple[str, int], Slot] = {}
    proposed: dict[tuple[str, int], list[float]] = {}
    places = {}
    for i, c in enumerate(columns):
        n = sizes[f"n{i}"]
        for j, p in enumerate(probs) if n else []:
            place = p * (n - 1)
            places[(c, p)] = place
            for rank in (math.floor(place), math.ceil(place)):
                slots.setdefault((c, rank), Slot(c, rank, 0, n))
                proposed.setdefault((c, rank), sizes[f"f{i}"][2 * j:2 * j + 2])

    limit, first_round = small_rows, True
    while True:
        waiting = [k for k, s in slots.items() if s.value is None and s.inside > limit]
        if not waiting:
            break
        now = [slots[k] for k in waiting]
        fences = [proposed[k] for k in waiting] if first_round else _proposed(numbers, now, values)
        slots.update(zip(waiting, _close_in(numbers, now, values, fences)))
        limit, first_round = fence_rows, False

    left = [s for s in slots.values() if s.value is None]
    ranked = _order(numbers, left, values) if left else {}

    def read(key):
        if key not in places:
            return None
        first, last = (slots[(key[0], rank)] for rank in (math.floor(places[key]), math.ceil(places[key])))
        a, b = (s.value if s.value is not None else ranked[s] for s in (first, last))
        return a if a == b else a + (b - a) * (places[key] - first.rank)

    return {c: [read((c, p)) for p in probs] for c in columns}
