"""Language identification by words first, then by ever shorter character n-grams.

A word that the model knows counts with the logarithm of its frequency in each language. A word that it does not know is
looked up by its character n-grams, longest first, word borders included: the first length of which any n-gram is known
decides, with the mean of their log frequencies. A text's scores are the sums over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulight.llm.flat import mix, runs, spans_hash, text_pieces, tidied

#: Character n-gram lengths, in the order of the lookup.
LENGTHS = (4, 3, 2, 1)
#: What stands before and after a word in its n-grams; no character of a word.
BORDER = 0x20
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0
    return np.char.isalpha(points.view("U1"))


def text_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, start and end of each run of letters in them, and each text's first run (one more than texts)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, *runs(letters[points], lead[offsets])


def word_ngrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word with a border on either side, and the place of the word they belong to."""
    size = ends - starts + 2
    total = np.cumsum(size)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)
    owner = np.repeat(np.arange(len(size)), size)
    inner = (place > 0) & (place < size[owner] - 1)
    padded = np.full(len(place), BORDER, np.uint64)
    padded[inner] = points[starts[owner[inner]] + place[inner] - 1]
    if n > len(padded):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(padded) - n + 1, np.uint64)
    for k in range(n):
        value = value * np.uint64(0x100000001B3) + padded[k: len(padded) - n + 1 + k]
    fits = place[: len(value)] + n <= size[owner[: len(value)]]
    if n == 1:
        fits &= inner
    return mix(value[fits] + np.uint64(n)), owner[: len(value)][fits]


@dataclass(frozen=True)
class Levels:
    """For words and for each n-gram length: sorted hashes, and each one's log frequency per language."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]


@tidied
def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (level 0) and n-grams per language, over the rows of a task."""
    letters = letter_table()
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        done = 0
        for data, offsets in text_pieces(batch.column("text")):
            points, starts, ends, first = text_words(data, offsets, letters)
            own = langs[done: done + len(offsets) - 1]
            done += len(offsets) - 1
            hashes, size = spans_hash(points, starts, ends), np.diff(first)
            for lang in sorted(set(own)):
                mine = np.flatnonzero(np.repeat(own == lang, size))
                keys, at, count = np.unique(hashes[mine], return_index=True, return_counts=True)
                found = [(0, keys, count)]
                for n in LENGTHS:
                    grams, owner = word_ngrams(points, starts[mine[at]], ends[mine[at]], n)
                    grams, which = np.unique(grams, return_inverse=True)
                    found.append((n, grams, np.bincount(which, count[owner], len(grams)).astype(np.int64)))
                for level, keys, count in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), level, np.int32)), pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)),
                         pa.array(count.astype(np.int64))], ["level", "lang", "h", "n"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 5_000, entries: int = 50_000) -> Levels:
    """The model, from about ``per_language`` documents of each language (all if it has fewer), chosen by a hash of the key.

    Rows with a null language or text teach nothing. Of each language and length the ``entries`` most frequent words or
    n-grams that occur twice or more are known (ties by hash), so the model's size is bounded.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.lower(text).alias("text")).where("lang is not null and text is not null")
    size = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(size)
    if not languages:
        return Levels([], {}, {})
    share = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(per_language / max(size[name], per_language)))))[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    counts = sample.mapInArrow(counting, "level int, lang string, h bigint, n bigint").groupBy("level", "lang", "h").agg(F.sum("n").alias("n")).where("n > 1")
    total = F.sum("n").over(W.partitionBy("level", "lang"))
    place = F.row_number().over(W.partitionBy("level", "lang").orderBy(F.desc("n"), "h"))
    known = counts.select("level", "lang", "h", "n", total.alias("total"), place.alias("place")).where(F.col("place") <= entries)
    known = known.select("level", "lang", "h", "n", "total").toArrow()          # at most ``entries`` a language and length
    number = {name: i for i, name in enumerate(languages)}
    level, h, n, sums = (known.column(c).to_numpy() for c in ("level", "h", "n", "total"))
    which = np.array([number[x] for x in known.column("lang").to_pylist()], np.int64)
    keys, logs = {}, {}
    for at in (0, *LENGTHS):
        own = level == at
        keys[at], place = np.unique(h[own].view(np.uint64), return_inverse=True)
        count, seen = np.zeros((len(keys[at]), len(languages))), np.zeros(len(languages))
        count[place, which[own]] = n[own]
        seen[which[own]] = sums[own]
        logs[at] = np.log((count + 0.5) / (seen + 0.5 * max(1, len(keys[at]))))
    return Levels(languages, keys, logs)


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash among the sorted keys, -1 where it is none of them."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, place, -1)


def score_words(model: Levels, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Log frequency per language of each word; zero for a word of which nothing is known."""
    out = np.zeros((len(hashes), len(model.languages)))
    place = look_up(model.keys[0], hashes)
    out[place >= 0] = model.logs[0][place[place >= 0]]
    left = np.flatnonzero(place < 0)
    for n in LENGTHS:
        grams, owner = word_ngrams(points, starts[left], ends[left], n)
        place = look_up(model.keys[n], grams)
        known = place >= 0
        seen = np.bincount(owner[known], minlength=len(left))
        for i in range(len(model.languages)):
            total = np.bincount(owner[known], model.logs[n][place[known], i], len(left))
            out[left[seen > 0], i] = total[seen > 0] / seen[seen > 0]
        left = left[seen == 0]
        if not len(left):
            break
    return out


def identify(text: Column, model: Levels) -> Column:
    """struct<lang_pred, score>: the language with the largest score, and its share in the likelihood of all languages.

    ``und`` and score 0 for a null text, one without a letter, and all texts if nothing was learned. Of equally likely
    languages the first by name is taken.
    """
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    @tidied
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = letter_table()
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in batches:
            best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
            for data, offsets in text_pieces(batch):
                points, starts, ends, first = text_words(data, offsets, letters)
                none, size = np.diff(first) == 0, np.diff(first)
                if not model.languages or none.all():
                    best.append(np.full(len(size), len(model.languages)))
                    share.append(np.zeros(len(size)))
                    continue
                hashes, at, which = np.unique(spans_hash(points, starts, ends), return_index=True, return_inverse=True)
                words = score_words(model, points, starts[at], ends[at], hashes)
                owner = np.repeat(np.arange(len(size)), size)
                total = np.stack([np.bincount(owner, words[which, i], len(size)) for i in range(len(model.languages))], axis=1)
                total -= total.max(axis=1, keepdims=True)
                best.append(np.where(none, len(model.languages), total.argmax(axis=1)))
                share.append(np.where(none, 0.0, 1 / np.exp(total).sum(axis=1)))
            yield pa.StructArray.from_arrays([names.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(share))], ["lang_pred", "score"])

    return language(F.lower(text))


def confident_only(docs: DataFrame, model: Levels, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least ``least``; those without a letter go. All columns stay.

    The share is one of summed likelihoods and near 1 for any text of a few dozen known words, texts of two languages included.
    """
    found = identify(F.col(text), model)
    return docs.where((found["score"] >= least) & (found["lang_pred"] != UNKNOWN))
