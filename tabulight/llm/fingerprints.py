"""Document fingerprints as homomorphic multiset hashes.

A document is a multiset of paragraphs (its lines without outer white space, blank ones left out). A paragraph hashes to a wide vector,
and a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of two. So the order of paragraphs does not
matter, and ``add`` and ``remove`` update a fingerprint by a paragraph alone.

A vector has two parts. The first eight lanes are the 64-bit words of the whole paragraph's BLAKE2b digest, modulo 2^64: equal multisets
are equal there, and different ones agree in all 512 bits only by chance. The other lanes, modulo 2^16, sketch what the paragraph says: each of its runs of three words adds 1 or takes 1
from one lane. Sums of sketches are the sketch of the sum, so the angle between two documents' lanes estimates how much
they share, also where paragraphs differ in a few words only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabulight.llm.flat import SPACE, flat_text, mix, pieces, runs, spans_hash, tidied, words

EXACT, LANES = 8, 256
WIDTH = 8 * EXACT + 2 * LANES
SHINGLE = 3
PART_ROWS, MAX_PARTS, SAMPLED_PER_PART = 2_000, 100_000, 8
START = 32


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact lanes (uint64) and sketch lanes (int64, before the modulo) of each text."""
    n = len(offsets) - 1
    exact, sketch = np.zeros((n, EXACT), np.uint64), np.zeros((n, LANES), np.int64)
    if not len(data):
        return exact, sketch
    starts, ends, first = runs(data != 0x0A, offsets)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    places = np.flatnonzero(~SPACE[data])
    blank = solid[starts] == solid[ends]
    owner = np.repeat(np.arange(n), np.diff(first))[~blank]
    starts, ends = starts[~blank], ends[~blank]
    if not len(starts):
        return exact, sketch
    starts, ends = places[solid[starts]], places[solid[ends] - 1] + 1            # without outer white space
    whole = memoryview(np.ascontiguousarray(data))
    digests = b"".join(hashlib.blake2b(whole[a:b], digest_size=8 * EXACT).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    exact[owner[heads]] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EXACT), heads, axis=0)
    begin, end, _ = words(data, offsets)
    hashes = spans_hash(data, begin, end)
    paragraph = np.searchsorted(starts, begin, "right") - 1
    size = np.bincount(paragraph, minlength=len(starts))
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    at = np.repeat((np.cumsum(size) - size) - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = np.repeat(np.cumsum(size), count)
    value = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        part = np.where(at + k < last, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0))
        value = mix(value * np.uint64(3) + part)
    sign = 1 - 2 * (value >> np.uint64(63)).astype(np.int64)
    cell = owner[np.repeat(np.arange(len(starts)), count)] * LANES + (value % np.uint64(LANES)).astype(np.int64)
    sketch += np.bincount(cell, sign, n * LANES).astype(np.int64).reshape(n, LANES)
    return exact, sketch


def packed(exact: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The fingerprints as bytes, one row each."""
    return np.concatenate([exact.astype("<u8").view(np.uint8), (sketch & 0xFFFF).astype("<u2").view(np.uint8)], axis=1)


def unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(raw[:, : 8 * EXACT]).view("<u8"), np.ascontiguousarray(raw[:, 8 * EXACT:]).view("<i2").astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints: 1 for equal ones, else the cosine of their sketches, negative ones as 0."""
    x, y = unpacked(a)[1].astype(float), unpacked(b)[1].astype(float)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cosine, 0, 1))


def of_texts(column: pa.Array) -> np.ndarray:
    parts = [packed(*vectors(d, o)) for d, o in pieces(*flat_text(column))]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.uint8)


def binary(raw: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def rows_of(column: pa.Array) -> np.ndarray:
    """Fingerprints (binary) as rows of bytes; null as that of an empty text."""
    column = pc.fill_null(column.cast(pa.binary()), bytes(WIDTH))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def fingerprint(text: Column) -> Column:
    """The fingerprint (binary) of a text; a null or empty text, or one of blank lines, has the empty multiset's (all zero)."""
    @F.arrow_udf("binary")
    @tidied
    def of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield binary(of_texts(batch))

    return of_text(text)


def _combined(sign: int):
    @F.arrow_udf("binary")
    def combine(whole: pa.Array, part: pa.Array) -> pa.Array:
        (e, s), (f, t) = unpacked(rows_of(whole)), unpacked(rows_of(part))
        return binary(packed(e + f if sign > 0 else e - f, s + sign * t))

    return combine


def add(whole: Column, part: Column) -> Column:
    """The fingerprint of a document after the paragraphs of another fingerprint have been added."""
    return _combined(1)(whole, part)


def remove(whole: Column, part: Column) -> Column:
    """The fingerprint of a document after the paragraphs of another fingerprint have been taken out."""
    return _combined(-1)(whole, part)


def _part_of(cuts: pa.Table) -> Callable[[Column, Column], Column]:
    """The number of cuts (key, start of text), in order and null keys last, that are not above a row's."""
    keys = cuts.column("doc_id").combine_chunks().drop_null().to_numpy(zero_copy_only=False)
    begins = np.array([*cuts.column("start").to_pylist(), None], object)[:-1]

    @F.arrow_udf("int")
    def part(key: pa.Array, start: pa.Array) -> pa.Array:
        known = key.is_valid().to_numpy(zero_copy_only=False)
        low, high = np.full(len(key), len(keys)), np.full(len(key), len(begins))
        values = key.drop_null().to_numpy(zero_copy_only=False)
        low[known], high[known] = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        tied = np.flatnonzero(low < high)                                       # rows with the key of a cut: their text decides
        tied = tied[np.argsort(low[tied], kind="stable")]
        found = low.copy()
        for same in np.split(tied, np.flatnonzero(np.diff(low[tied])) + 1) if len(tied) else []:
            a, b = low[same[0]], high[same[0]]
            texts = np.array([*start.take(pa.array(same)).to_pylist(), None], object)[:-1]
            found[same] = a + np.searchsorted(begins[a:b], texts, "right")
        return pa.array(found, pa.int32())

    return part


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """The documents by part and key, and for each part the text that follows its last one.

    Documents are cut at sampled places of their order (key, nulls last, then text) into parts of about ``part_rows`` (more, if that made
    over MAX_PARTS), so no task orders many more than that. The key may be of any type with an order. Rows of one key, or without
    one, are cut by the start of their texts; only those that agree there as well stay in one part, through which
    they stream. A part's follower is the first document of the next part that has any; the first of all follows
    the last. The driver gets SAMPLED_PER_PART places for each part.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("start", F.substring("text", 1, START))
    n = rows.count()
    parts = min(MAX_PARTS, max(1, -(-n // part_rows)))
    part = F.lit(0)
    if parts > 1:
        drawn = rows.where(F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(1, n // (SAMPLED_PER_PART * parts)))) == 0)
        places = drawn.select("doc_id", "start").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "start").toArrow()
        every = max(1, len(places) // parts)
        part = _part_of(places.take(pa.array(range(every, len(places), every), pa.int64())))(F.col("doc_id"), F.col("start"))
    rows = rows.withColumn("part", part)
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")).alias("least"))
    order = W.orderBy("part")                                                   # over at most MAX_PARTS rows
    own = F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    wanted = least.select(F.col("part").alias("after"), own.alias("own"), F.col("least.doc_id").alias("low"), F.col("least.start").alias("low_start"))
    heads = rows.join(F.broadcast(wanted), (F.col("part") == F.col("after")) & F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("start") == F.col("low_start")))
    return rows.drop("start"), heads.groupBy(F.col("own").alias("part")).agg(F.min("text").alias("text"))


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by as many from the start of the next document,
    or all of it. Documents follow each other by key, nulls last, rows with one key by text; the first follows the last. A null
    text is empty. Columns: ``doc_id`` (in the key's type), ``n_chars``, ``edited`` (text), ``fingerprint``, ``edited_fingerprint`` (binary),
    ``near_edited``, ``near_next``; other columns of the table are not read, so their names may clash. Very long texts make a piece of their
    own. Repeated rows are rows of their own. An empty table gives an empty one.
    """
    rows, heads = with_next(docs, text, key, part_rows)
    kind = rows.schema["doc_id"].dataType
    both = rows.select("part", F.lit(0).alias("tail"), "doc_id", "text").unionByName(heads.select("part", F.lit(1).alias("tail"), F.lit(None).cast(kind).alias("doc_id"), "text"))
    ordered = both.repartition("part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "text")

    @tidied
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                                             # the last document, whose follower is not yet known
        for batch in batches:
            for done in range(0, batch.num_rows, 2_000):
                piece = pa.Table.from_batches([batch.slice(done, 2_000)])
                if held is not None:
                    piece = pa.concat_tables([held, piece])
                piece = piece.combine_chunks()
                held = piece.slice(piece.num_rows - 1)
                yield from edited(piece)

    def edited(piece: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, part, tail = piece.column("text").to_pylist(), piece.column("part").to_numpy(), piece.column("tail").to_numpy()
        own = np.flatnonzero((tail[:-1] == 0) & (part[:-1] == part[1:]))
        if not len(own):
            return
        now = []
        for i in own.tolist():
            last = len(texts[i]) // 4
            now.append(texts[i][: len(texts[i]) - last] + texts[i + 1][:last])
        every = of_texts(piece.column("text"))
        before, after, following = every[own], of_texts(pa.array(now, pa.large_string())), every[own + 1]
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id").combine_chunks().take(pa.array(own)), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()), pa.array(now, pa.string()),
            binary(before), binary(after), pa.array(likeness(before, after)), pa.array(likeness(before, following)),
        ], ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(edit, T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType()), T.StructField("edited", T.StringType()), T.StructField("fingerprint", T.BinaryType()),
        T.StructField("edited_fingerprint", T.BinaryType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]))
