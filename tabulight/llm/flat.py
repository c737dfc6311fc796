"""Text columns as flat byte arrays, so that numpy handles a batch of texts at once.

Everything works in pieces of a megabyte, so memory does not grow with the batch; only a single text that is
larger than a piece makes a larger one.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from functools import wraps
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
#: Where the columns of a whole pipeline run in the same workers: numpy holds some fifty to a hundred bytes for each of these.
PART_BYTES = 1 << 18
#: Words are separated by these bytes: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def give_back() -> None:
    """Free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over batches, giving its memory back to the system when it ends, and what an earlier task left when it begins.

    Python workers wait for the next task with all the memory they ever needed; there may be several of them beside an executor.
    """
    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def worker_memory(name: tuple, make: Callable):
    """What ``make`` gave at its first call in this Python worker: later tasks of the worker find what earlier ones have learnt.

    Functions reach a worker by value, each with its own globals, so it lies in a module of its own.
    """
    held = sys.modules.setdefault("_tabulight_worker", ModuleType("_tabulight_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in runs of about ``limit`` bytes; a text is never cut."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def text_pieces(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a string column, in runs of rows of about ``limit`` bytes: no copy of a whole batch is made."""
    for part in slices(column, limit):
        yield flat_text(part)


def slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A string column in runs of rows of about ``limit`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + limit, "right")))
        yield column.slice(first, last - first)
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true bytes within one text, and each text's first run (one more than texts)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0] = closes[-1] = True
    np.logical_not(inside[:-1], out=opens[1:])
    np.logical_not(inside[1:], out=closes[:-1])
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = True
    closes[edges - 1] = True
    starts, ends = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each text's first word (one more than texts)."""
    return runs(~SPACE[data], offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values (the finaliser of SplitMix64)."""
    v = values.astype(np.uint64)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and do not overlap.

    The polynomial sum of the bytes, modulo 2^64, then mixed with the length.
    """
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if len(starts) == 0:
        return out
    powers = np.cumprod(np.full(min(int(lengths.max()), 1 << 16), MULTIPLIER, np.uint64))
    total, first = np.concatenate([[0], np.cumsum(lengths)]), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
        size = lengths[first: last]
        begin = np.repeat(starts[first: last], size)
        place = np.arange(total[last] - total[first]) - np.repeat(total[first: last] - total[first], size)
        values = (data[begin + place].astype(np.uint64) + np.uint64(1)) * powers[place % len(powers)]
        full = size > 0
        if full.any():
            out[first: last][full] = np.add.reduceat(values, (total[first: last] - total[first])[full])
        first = last
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    parts = [np.diff(words(d, o)[2]) for d, o in text_pieces(column)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings of adjoining spans (each ends where the next starts), and the place of each span among them."""
    offsets = np.append(starts, ends[-1:] if len(ends) else 0).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
