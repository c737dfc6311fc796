"""Quality by importance resampling: how much likelier a text is under good texts' n-grams than under all texts' n-grams.

Two bag models over hashed word n-grams (words and pairs of words, punctuation apart) are counted: one from texts labelled
good, one from all texts. A document's weight is the ratio of its likelihoods under the two, taken at equal length for all
(``concentration`` n-grams), and documents are drawn without replacement with chances in proportion to their weights:
the k largest sums of log weight and Gumbel noise. k is the number of documents that lie on the good side of the best cut
between texts labelled good and bad. The noise is a hash of key and seed, so reruns draw the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulight.llm.flat import SPACE, mix, spans_hash, text_pieces, tidied
from tabulight.llm.select import kth_largest
from tabulight.llm.storage import fresh, kept

BUCKETS = 10_000
#: Log ratios are kept as whole numbers of this fraction: sums are then exact in any order.
UNIT = 1 << 20
#: 0 white space, 1 letters, digits and all bytes of other alphabets, 2 other signs.
CLASS = np.full(256, 2, np.uint8)
CLASS[SPACE] = 0
CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words of each text, text after text; each text's number of them."""
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    kind = CLASS[data]
    opens = np.append(True, kind[1:] != kind[:-1]) if len(data) else np.zeros(0, bool)
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    single = spans_hash(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    pair = mix(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:]) if len(single) > 1 else np.zeros(0, np.uint64)
    same = text[:-1] == text[1:] if len(text) > 1 else np.zeros(0, bool)
    order = np.argsort(np.concatenate([2 * np.arange(len(single)), 2 * np.flatnonzero(same) + 1]), kind="stable")
    grams = np.concatenate([single, pair[same]])[order]
    return (grams % np.uint64(buckets)).astype(np.int64), np.where(count > 0, 2 * count - 1, 0)


@dataclass(frozen=True)
class Ratios:
    """The fitted models: the log ratio of each bucket in units, and the cut between good and bad mean log ratios."""

    units: np.ndarray
    cut: float


def score(text: Column, units: np.ndarray) -> Column:
    """Mean log ratio of a text's n-grams; null for a text without any (null, empty, blank)."""
    @F.arrow_udf("double")
    @tidied
    def mean_ratio(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [np.zeros(0)]
            for data, offsets in text_pieces(batch):
                grams, count = ngrams(data, offsets, len(units))
                total = np.concatenate([[0], np.cumsum(units[grams])])
                end = np.cumsum(count)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out.append((total[end] - total[end - count]) / (count * UNIT))
            yield pa.array(np.concatenate(out), from_pandas=True)

    return mean_ratio(text)


def counted(docs: DataFrame, buckets: int) -> dict[bool, np.ndarray]:
    """Counts per bucket over the texts marked ``target``, and over all texts. The driver gets at most two counts a bucket."""
    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = np.asarray(batch.column("target").fill_null(False).to_numpy(zero_copy_only=False), bool)
            done = 0
            for data, offsets in text_pieces(batch.column("text")):
                grams, n = ngrams(data, offsets, buckets)
                total[0] += np.bincount(grams, minlength=buckets)
                total[1] += np.bincount(grams[np.repeat(target[done: done + len(n)], n)], minlength=buckets)
                done += len(n)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which == 1), pa.array(bucket.astype(np.int32)), pa.array(total[which, bucket])], ["target", "bucket", "n"])

    rows = docs.mapInArrow(count, "target boolean, bucket int, n bigint").groupBy("target", "bucket").agg(F.sum("n")).collect()
    out = {True: np.zeros(buckets, np.int64), False: np.zeros(buckets, np.int64)}
    for target, bucket, n in rows:
        out[target][bucket] = n
    return out


def labelled(labels: DataFrame, key: str, quality: str, bound: int) -> DataFrame:
    """About ``bound`` labelled keys of each class at most (``doc_id``, ``good``), by a hash of the key. Contrary labels cancel."""
    one = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.min(F.col(quality) > 0).alias("good"), F.max(F.col(quality) > 0).alias("top")).where("good = top").drop("top")
    size = {r[0]: r[1] for r in one.groupBy("good").count().collect()}
    share = F.when(F.col("good"), F.lit(bound / max(size.get(True, 0), bound))).otherwise(F.lit(bound / max(size.get(False, 0), bound)))
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1 << 30)) < share * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", buckets: int = BUCKETS,
        bound: int = 20_000) -> Ratios:
    """Both models and the cut.

    The model of all texts covers every document. That of good texts, and the cut, come from at most about ``bound`` labelled
    documents of each class, so their keys may be broadcast. Without good labels all ratios are zero; without bad ones
    there is no cut.
    """
    sample = F.broadcast(labelled(labels, key, quality, bound))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id", "left")
    counts = counted(rows.select("text", F.coalesce("good", F.lit(False)).alias("target")), buckets)
    target, raw = counts[True], counts[False]
    if not target.any():
        return Ratios(np.zeros(buckets, np.int64), float("-inf"))
    chance = lambda n: np.log((n + 1.0) / (n.sum() + buckets))
    units = np.round((chance(target) - chance(raw)) * UNIT).astype(np.int64)
    known = rows.where("good is not null").select("good", score(F.col("text"), units).alias("score")).where("score is not null").collect()
    return Ratios(units, best_cut(np.array([r.good for r in known], bool), np.array([r.score for r in known], float)))


def best_cut(good: np.ndarray, scores: np.ndarray) -> float:
    """The cut with the fewest errors, both classes weighing the same: between two scores, in the widest gap of several."""
    if good.all() or not good.any():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    error = np.cumsum(good)[:-1] / good.sum() + 1 - np.cumsum(~good)[:-1] / (~good).sum()
    gap = np.diff(scores)
    error[gap <= 0] = np.inf
    if not np.isfinite(error).any():
        return float("-inf")
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = best[np.argmax(gap[best])]
    return float((scores[at] + scores[at + 1]) / 2)


def gumbel(key: Column, seed: int) -> Column:
    """Noise of the standard Gumbel distribution from a hash of the key."""
    part = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(part))


def draw(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", buckets: int = BUCKETS,
         bound: int = 20_000, concentration: float = 1000.0, seed: int = 42) -> tuple[DataFrame, Column, Column]:
    """Scores of all documents (``doc_id``, ``score``, ``drawn_by``), and for ``docs`` itself its drawing key and the test for being drawn.

    A text without words has neither and is not drawn. Rows with equal key and text share their fate; rows tied with
    the last one drawn are drawn too. A null key is a key like any other. An empty table gives an empty one.
    """
    ratios = fit(docs, labels, text, key, quality, buckets, bound)
    value = score(F.col(text), ratios.units)
    noisy = lambda s, k: s * concentration + gumbel(k, seed)
    scored = kept(docs.select(F.col(key).alias("doc_id"), value.alias("score")))
    scored = scored.withColumn("drawn_by", noisy(F.col("score"), F.col("doc_id")))
    k = scored.where(F.col("score") >= ratios.cut).count()
    last = kth_largest(scored, "drawn_by", k)
    key_of_row = noisy(value, F.col(key))
    return scored, key_of_row, F.lit(float("inf") if last is None else last)


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``score``, ``drawn_by``, ``kept``. See ``draw`` for the rows' treatment."""
    scored, _, last = draw(docs, labels, **options)
    return scored.withColumn("kept", F.coalesce(F.col("drawn_by") >= last, F.lit(False)))


def drawn_only(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns."""
    _, key_of_row, last = draw(docs, labels, **options)
    by, = fresh(docs.columns, "drawn_by")
    return docs.withColumn(by, key_of_row).where(F.col(by) >= last).drop(by)
