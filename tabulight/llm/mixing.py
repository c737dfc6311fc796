"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (how often the mix holds it, at most ``most``) such that the rates times the sizes add up to the target of
each source, and the rates depart as little as possible, by relative entropy, from taking everything once. The
solution tilts exponentially: rate = min(most, exp(tilt of the source x size / mean size of the source)). The tilts solve the
convex dual problem, by Newton steps within a bracket, for all sources at once. A step needs the number of documents of each
source and size only. Rates then become whole copies: within small groups of a source, largest documents first, an extra copy
is taken when the words owed reach half of the document, so a group's error is about half its smallest document. A key that more documents
than a group has share is dealt by the texts too, and such a text by the place in the table, so no key fills one group.

Rows
    Null and empty texts have size 0 and are never taken more than once. A null source is a source of its own, after all others. A null
    key orders like the smallest; repeated rows are separate rows, told apart by no more than their order. A source without
    words has target 0. An empty table gives an empty one. All other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulight.llm.flat import give_back, tidied, word_counts
from tabulight.llm.storage import fresh, kept

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents in a rounding group, about.
GROUP = 4_000
ROUNDS = 60
CLOSE = 1e-9
#: With more sources than this their tilts are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 200_000


def size_of(text: Column) -> Column:
    """Number of words of a text (runs of anything but the six ASCII white space characters); null has none."""
    @F.arrow_udf("bigint")
    @tidied
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(word_counts(batch))

    return size(text)


def weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``weight`` for rows of distinct ``source``: the weights in turn, sources by code point, null last.

    Only the names of the sources are ordered, in one window: one row per source, however many documents it has.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*(F.lit(float(w)) for w in weights))
    return sources.withColumn("weight", F.element_at(turn, (place % len(weights) + 1).cast("int")))


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``target`` for rows of ``source``, ``words``: shares of ``share`` x all words by weight, none above ``most`` x its own.

    What is cut off is shared again by weight among the sources not yet at their limit, until none is above it.
    """
    rows = kept(weighted(totals, weights))
    everything = rows.agg(F.sum("words")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    for _ in range(rows.count() + 1):
        capped, open_weight = rows.agg(
            F.sum(F.when(full, most * F.col("words")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        before, level = level, max(0.0, (share * everything - capped) / open_weight)
        full = F.col("weight") * F.lit(level) > most * F.col("words")
        if level == before:
            break
    return rows.withColumn("target", F.when(full, most * F.col("words")).otherwise(F.col("weight") * F.lit(level)))


def tilts(sizes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """``tilt`` of each source. ``sizes``: source, size, n (documents). ``goals``: source, words, docs, target.

    A source whose target is its limit has an infinite tilt: all its rates are ``most``.
    """
    full = F.col("target") >= most * F.col("words") * (1 - 1e-12)
    state = goals.select("source", "target", (F.col("words") / F.col("docs")).alias("mean"), full.alias("full"),
                         F.lit(0.0).alias("tilt"), F.lit(-1e3).alias("low"), F.lit(1e3).alias("high"), F.lit(False).alias("done"))
    state = kept(state.withColumn("done", F.col("full") | (F.col("mean") == 0)))
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        open_rows = state.where("not done").withColumnRenamed("source", "of")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(np.log(most))))
        free = F.col("tilt") * x < np.log(most)
        step = sizes.join(open_rows, F.col("source").eqNullSafe(F.col("of"))).select(
            "of", (F.col("n") * F.col("size") * rate).alias("mass"),
            F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0).alias("slope"),
        ).groupBy("of").agg(F.sum("mass").alias("mass"), F.sum("slope").alias("slope"))
        moved = state.join(step, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        miss = F.col("mass") - F.col("target")
        moved = moved.withColumn("low", F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        good = F.abs(miss) <= CLOSE * F.col("target")
        nxt = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = kept(moved.select("source", "target", "mean", "full", F.when(F.col("done") | good, F.col("tilt")).otherwise(nxt).alias("tilt"),
                                  "low", "high", (F.col("done") | F.coalesce(good, F.lit(True))).alias("done")))
    return state.select("source", "mean", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("tilt")).alias("tilt"))


def rounded(rate: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whole copies of documents in the given order: the rate rounded down, and one more whenever half a document is owed."""
    base = np.floor(rate + 1e-12)
    part, extra, owed = (rate - base) * size, np.zeros(len(rate), np.int64), 0.0
    for i, (more, words) in enumerate(zip(part.tolist(), size.tolist(), strict=True)):
        if more > 0:
            owed += more
            if owed >= words / 2:
                extra[i] = 1
                owed -= words
    return base.astype(np.int64) + extra


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, carry: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns ``carry`` (all by default) of each document with size, source_size, target, rate and copies, and the names of these five.

    A name that ``carry`` has already gets a leading underscore. Each row is read once more for the rounding, with a
    shuffle by source and group; everything before works on counts by source and size.
    """
    carry = docs.columns if carry is None else carry
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    own = fresh(docs.columns, "_size", "_of", "_words", "_docs", "_target", "_mean", "_tilt", "_group", "_key", "_text", "_source", "_salt", "_hot")
    size, of, words, count, target, mean, tilt, group, order_key, order_text, of_row, salt, hot = own
    sized = docs.withColumn(size, size_of(quoted(text)))
    narrow = kept(sized.select(quoted(source).alias("source"), F.col(size).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    goals = kept(targets(totals, weights, share, most))
    solved = tilts(narrow, goals, most).withColumnRenamed("source", "of")
    plan = goals.join(solved, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias(of), F.col("words").alias(words), F.col("docs").alias(count), F.col("target").alias(target),
        F.col("mean").alias(mean), F.col("tilt").alias(tilt))
    names = fresh(carry, "size", "source_size", "target", "rate", "copies")
    plan = kept(plan)
    few = plan.count() <= BROADCAST_SOURCES                                     # a few dozen bytes each
    sized = sized.withColumn(order_text, F.xxhash64(quoted(text))).withColumn(order_key, quoted(key)).withColumn(of_row, quoted(source))
    names_of = docs.select(quoted(source).alias(of_row), F.xxhash64(quoted(key)).alias(hot), F.xxhash64(quoted(text)).alias(order_text))
    crowded = lambda df, *by: kept(df.groupBy(*by).count().where(F.col("count") > GROUP).select(*by))
    hot_keys = crowded(names_of, of_row, hot)
    if hot_keys.isEmpty():
        sized = sized.withColumn(salt, F.lit(0).cast("bigint"))
    else:                                                                       # a row per GROUP documents at most
        same = lambda a, b, by: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by))
        hot_rows = crowded(names_of.alias("r").join(F.broadcast(hot_keys.alias("h")), same("r", "h", (of_row, hot)), "left_semi"), of_row, hot, order_text)
        one = lambda df: F.broadcast(df.withColumn("found", F.lit(True)))
        sized = sized.withColumn(hot, F.xxhash64(order_key)).withColumn(salt, F.monotonically_increasing_id())
        sized = sized.alias("r").join(one(hot_keys).alias("k"), same("r", "k", (of_row, hot)), "left").join(
            one(hot_rows).alias("e"), same("r", "e", (of_row, hot, order_text)), "left")
        spread = F.when(F.col("e.found"), F.xxhash64(F.col(f"r.{order_text}"), F.col(f"r.{salt}"))).when(F.col("k.found"), F.xxhash64(F.col(f"r.{order_text}")))
        sized = sized.select("r.*", F.coalesce(spread, F.lit(0).cast("bigint")).alias("_spread")).drop(salt).withColumnRenamed("_spread", salt)
    sized = sized.select(*(quoted(c) for c in carry), size, order_text, order_key, of_row, salt)
    rows = sized.join(F.broadcast(plan) if few else plan, F.col(of_row).eqNullSafe(F.col(of)))
    tilted = F.exp(F.least(F.col(tilt) * F.col(size) / F.col(mean), F.lit(float(np.log(most)))))
    rate = F.when((F.col(size) == 0) | (F.col(mean) == 0), F.lit(1.0)).when(F.col(tilt) == float("inf"), F.lit(float(most))).otherwise(tilted)
    rows = rows.select(
        *(quoted(c) for c in carry), F.col(size).alias(names[0]), F.col(words).alias(names[1]), F.col(target).alias(names[2]), rate.alias(names[3]),
        F.col(of), F.pmod(F.xxhash64(order_key).bitwiseXOR(F.col(salt)), F.ceil(F.col(count) / F.lit(GROUP))).alias(group), order_key, order_text)
    out = rows.select(*(quoted(c) for c in carry), *names[:4], F.lit(0).cast("bigint").alias(names[4])).schema
    order = [(names[0], "descending"), (order_key, "ascending"), (order_text, "ascending")]

    def take(part: pa.Table) -> pa.Table:
        if part.nbytes > 1 << 20:
            give_back()                                                         # what the group before took
        part = part.sort_by(order)
        copies = rounded(part.column(names[3]).to_numpy(), part.column(names[0]).to_numpy())
        return part.drop_columns([of, group, order_key, order_text]).append_column(names[4], pa.array(copies))

    return rows.groupBy(of, group).applyInArrow(take, out), names


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it has copies, with the columns of ``docs``."""
    mixed, names = mix(docs, **options)
    one, = fresh(mixed.columns, "one")
    copies = F.explode(F.array_repeat(F.lit(1), F.col(names[4]).cast("int")))          # none for 0
    return mixed.withColumn(one, copies).select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
