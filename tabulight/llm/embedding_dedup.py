"""Near-duplicate vectors by cosine, found with inverted multi-indexes.

Each of ``TABLES`` tables is an inverted multi-index over the components of the normalised vectors in an order of its own: the halves get
a codebook each, and a cell is a pair of codewords, one of each half. A vector lies in the cells nearest to it by the sum of its two halves' squared
distances (multi-sequence traversal: the halves' codewords are sorted by distance, and the next cell is always a neighbour of one
already visited). Two vectors meet if they lie in a common cell of any table. How many cells a vector visits is fitted: the fewest with which
the wanted share of a sample of queries meets all its links, as a comparison with all vectors shows. All pairs that meet are verified in
double precision (in single precision where that leaves no doubt).

Links are counted, not listed: a task compares the vectors of some cells, counts a pair in its first common cell only, and returns counts and the links of a
spanning forest. Cells of many vectors are cut into blocks, and each pair of blocks is a part of its own, so that no task gets more.
The copies of the vectors that lie in the cells are shuffled in turns, as many bytes a turn as ``TURN_BYTES`` or ``TURN_SHARE`` times the vectors
themselves; each turn's shuffle is deleted before the next but one, so disk does not grow with the number of visits.

Rows
    Equal vectors are compared once, as one vector with many copies; they are told by two 64-bit hashes. Vectors that are null, empty or zero, or hold a null or
    non-finite component, link with nothing, nor do vectors of different lengths. Keys may be null or repeated: each row is a vector. A null key
    never becomes a component's id unless all its keys are null. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulight.llm.flat import tidied
from tabulight.llm.graph import components
from tabulight.llm.simhash import forest
from tabulight.llm.storage import kept, let_go, new_folder, remove_folder

TABLES = 6
#: Vectors of a cell that are compared as one block, and rows of it that are multiplied at once at most; pairs at once.
BLOCK_VECTORS, BLOCK_QUERIES, PAIRS = 8192, 2048, 1 << 20
#: Bytes of copies shuffled in a turn: the larger of these, the second times the bytes of the vectors.
TURN_BYTES, TURN_SHARE = 256 << 20, 1.5
#: Bytes of a part of a turn, of a row of packed vectors, and of copies gathered before they are written.
PART_BYTES, PACK_BYTES, GATHER_BYTES = 8 << 20, 1 << 20, 8 << 20
#: Sample queries with links outside their first cell, from which their ranks alone decide on the number of visits.
LINKED = 200


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of doubles scaled to length one."""
    scale = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    rows = rows / np.where(scale > 0, scale, 1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from a list column, zeros after the end of shorter vectors; scaled to length one."""
    offsets, values = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values, float)
    size = np.diff(offsets)
    out = np.zeros((len(size), width))
    place = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)
    out[np.repeat(np.arange(len(size)), size), place] = values[offsets[0]: offsets[-1]]
    return unit(out)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, 0)


def nearest(distances: np.ndarray, n: int) -> np.ndarray:
    """The columns of the ``n`` smallest values of each row, smallest first."""
    if n >= distances.shape[1]:
        return distances.argsort(axis=1, kind="stable")
    if n <= 8:                                                          # quicker than a partition
        left, rows, out = distances.copy(), np.arange(len(distances)), np.zeros((len(distances), n), np.int64)
        for k in range(n):
            out[:, k] = left.argmin(axis=1)
            left[rows, out[:, k]] = np.inf
        return out
    some = np.sort(np.argpartition(distances, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(some, np.take_along_axis(distances, some, axis=1).argsort(axis=1, kind="stable"), axis=1)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centres of the rows by Lloyd's algorithm, from evenly spaced rows of the sample."""
    centres = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        own = squares(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=size)
        total = np.stack([np.bincount(own, x[:, d], size) for d in range(x.shape[1])], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves of the components, in the order ``order`` (as they are, without one)."""

    first: np.ndarray
    second: np.ndarray
    order: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        x = x if self.order is None else x[:, self.order]
        return squares(x[:, :half], self.first), squares(x[:, half:], self.second)

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each query, nearest first.

        The multi-sequence order for many queries at once: among the cells (i, j) of the sorted codewords, only those
        with (i + 1) (j + 1) <= visits can be among the nearest, since all cells with smaller i and j come before.
        """
        a, b = self.distances(x)
        left, right = nearest(a, visits), nearest(b, visits)
        below = np.minimum(visits // (np.arange(left.shape[1]) + 1), right.shape[1])
        i = np.repeat(np.arange(left.shape[1]), below)
        j = np.arange(len(i)) - np.repeat(np.cumsum(below) - below, below)
        total = np.take_along_axis(a, left, axis=1)[:, i] + np.take_along_axis(b, right, axis=1)[:, j]
        order = total.argsort(axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(left[:, i] * len(self.second) + right[:, j], order, axis=1)


@dataclass(frozen=True)
class Tables:
    """The tables, and the number of cells that a vector lies in, over all of them."""

    tables: tuple[Index, ...]
    width: int
    visits: int = 0

    @property
    def cells(self) -> int:
        return self.tables[0].cells

    @property
    def each(self) -> int:
        return self.visits // len(self.tables)

    @property
    def kind(self) -> str:
        """Type of a cell's number in its table."""
        return "<u2" if self.cells <= 1 << 16 else "<u4"

    def places(self, x: np.ndarray) -> np.ndarray:
        """The cells of each vector in each table, one table after the other."""
        out = np.zeros((len(x), self.visits), self.kind)
        for done in range(0, len(x), 1024):
            for t, table in enumerate(self.tables):
                out[done: done + 1024, t * self.each: (t + 1) * self.each] = table.traverse(x[done: done + 1024], self.each)
        return out

    def keys(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the cells among those of all tables."""
        return places.astype(np.int32) + np.repeat(np.arange(len(self.tables), dtype=np.int32) * self.cells, self.each)

    def meeting(self, x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many cells a table two vectors, rows ``i`` of ``x`` and ``j`` of ``y``, must visit to meet."""
        out, left, visits = np.full(len(i), self.cells), np.arange(len(i)), 4
        while len(left) and visits < self.cells:
            most = np.maximum.outer(np.arange(visits), np.arange(visits)).astype(np.int32) + 1 if visits <= 256 else None
            step = max(1, (1 << 22) // visits ** 2) if visits <= 256 else 64
            for done in range(0, len(left), step):
                at = left[done: done + step]
                (rows, one), (others, two) = np.unique(i[at], return_inverse=True), np.unique(j[at], return_inverse=True)
                for table in self.tables:
                    a, b = table.traverse(x[rows], visits)[one], table.traverse(y[others], visits)[two]
                    if most is None:
                        met = np.array([min((np.maximum(k, m) + 1).min(initial=self.cells), self.cells) for p, q in zip(a, b, strict=True)
                                        for _, k, m in [np.intersect1d(p, q, assume_unique=True, return_indices=True)]])
                    else:
                        met = np.where(a[:, :, None] == b[:, None, :], most, self.cells).min(axis=(1, 2))
                    out[at] = np.minimum(out[at], met)
            left = left[out[left] >= self.cells]
            visits *= 4
        return out


def sampled(vectors: DataFrame, count: int, sample: int) -> pa.Array:
    """The vectors with the smallest hashes."""
    order = lambda rows: rows.orderBy(F.xxhash64("vector"), "node").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    share = 1.5 * (sample + 100) / count
    if share < 1:                                                       # so that a task orders only a few more than are wanted
        found = order(vectors.where(F.xxhash64("vector") < F.lit(int(share * 2 ** 64) - 2 ** 63)))
        if len(found) == sample:
            return found
    return order(vectors)


def fit(vectors: DataFrame, threshold: float, recall: float, sample: int, queries: int, per_cell: int, largest: int, least: int) -> Tables | None:
    """Codebooks from a sample of at most ``sample`` vectors, visits from at most ``queries`` of them; None without vectors.

    Samples are those with the smallest hashes. The sample queries are compared with all vectors, in blocks: how far a query must go for
    its last link is measured on the real data. Where fewer than ``LINKED`` have a link outside their first cell, pairs are made as well, a
    vector and another at the threshold from it, and the larger number of visits counts.
    """
    count, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return None
    x = matrix(sampled(vectors, count, sample), width)
    size = int(np.clip(np.ceil(np.sqrt(count / per_cell)), 2, largest))
    half, rng, tables = max(1, width // 2), np.random.default_rng(0), []
    for t in range(TABLES):
        order = rng.permutation(width) if t else None
        y = np.roll(x if order is None else x[:, order], t * (len(x) // (size * TABLES)), axis=0)  # each begins from rows of its own
        tables.append(Index(codebook(y[:, :half], size), codebook(y[:, half:], size) if width > half else np.zeros((1, 0)), order))
    index = Tables(tuple(tables), width)
    q = x[:queries]

    @tidied
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(len(q), np.int64)
        for batch in batches:
            column = batch.column("vector")
            for done in range(0, len(column), 2048):
                part = matrix(column.slice(done, 2048), width)
                near, other = np.nonzero(q @ part.T >= threshold)
                np.maximum.at(last, near, index.meeting(q, near, part, other))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(last)], ["query", "rank"])

    # A query finds itself first: only those with another vector in a later cell tell anything.
    rows = vectors.select("vector").mapInArrow(ranks, "query bigint, rank bigint").groupBy("query").agg(F.max("rank").alias("rank")).collect()
    found = sorted(r["rank"] for r in rows if r["rank"] > 1)
    wanted = lambda ranks: int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
    visits = wanted(found) if found else 0
    if len(found) < LINKED:                                             # too few to tell how far links go: not below pairs at the threshold
        noise = rng.normal(size=q.shape)
        noise -= (noise * q).sum(axis=1, keepdims=True) * q
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        every = np.arange(len(q))
        visits = max(visits, wanted(sorted(index.meeting(q, every, threshold * q + np.sqrt(1 - threshold ** 2) * noise, every))))
    return Tables(index.tables, width, min(max(-(-least // TABLES), visits), index.cells) * TABLES)


def packed(vectors: DataFrame, index: Tables, kind: str) -> DataFrame:
    """Many vectors of one length a row, as bytes: ``size``, ``node``, ``copies``, ``vector`` (components of type ``kind``), ``places``."""
    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            offsets, values = np.asarray(batch.column("vector").offsets).astype(np.int64), np.asarray(batch.column("vector").values)
            sizes = np.diff(offsets)
            for size in np.unique(sizes):
                at, step = np.flatnonzero(sizes == size), max(64, PACK_BYTES // int(size * np.dtype(kind).itemsize + 100))
                for done in range(0, len(at), step):
                    part = at[done: done + step]
                    raw = values[offsets[part][:, None] + np.arange(size)].astype(kind)
                    x = np.zeros((len(part), index.width))
                    x[:, :size] = raw
                    row = [node[part].astype("<i8"), copies[part].astype("<i8"), raw, index.places(unit(x))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(size)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in row)],
                                                     ["size", "node", "copies", "vector", "places"])

    return vectors.select("node", "copies", "vector").mapInArrow(pack, "size int, node binary, copies binary, vector binary, places binary")


def crowds(packs: DataFrame, index: Tables) -> np.ndarray:
    """How many vectors lie in each cell of each table."""
    n, chunk = index.cells * len(index.tables), 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n, np.int64)
        for batch in batches:
            for places in batch.column("places"):
                found += np.bincount(index.keys(np.frombuffer(places.as_buffer(), index.kind).reshape(-1, index.visits)).reshape(-1), minlength=n)
        parts = [(c, found[c * chunk: (c + 1) * chunk]) for c in range(-(-n // chunk))]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts]), pa.array([p.astype("<i8").tobytes() for _, p in parts], pa.binary())], ["chunk", "n"])

    def total(group: pa.Table) -> pa.Table:
        every = sum(np.frombuffer(x.as_buffer(), "<i8") for x in group.column("n"))
        return pa.table([group.column("chunk").slice(0, 1), pa.array([every.tobytes()], pa.binary())], ["chunk", "n"])

    rows = packs.select("places").mapInArrow(count, "chunk bigint, n binary").groupBy("chunk").applyInArrow(total, "chunk bigint, n binary").collect()
    out = np.zeros(n, np.int64)
    for r in rows:
        out[r["chunk"] * chunk: r["chunk"] * chunk + len(r["n"]) // 8] = np.frombuffer(r["n"], "<i8")
    return out


@dataclass(frozen=True)
class Plan:
    """Which part of which turn compares a cell: cells of one part each, and cells cut into blocks with a part for each pair of blocks."""

    part: np.ndarray                                                    # of each cell, -1 for those cut into blocks
    large: np.ndarray                                                   # cells cut into blocks, ascending
    blocks: np.ndarray                                                  # of each of those
    first: np.ndarray                                                   # part of each one's first pair of blocks
    turns: int

    @staticmethod
    def of(crowd: np.ndarray, each: int, turn_bytes: float, partitions: int) -> Plan:
        """``each``: bytes of a vector's copy. Copies are dealt to parts of about equal size, four a partition and turn at least."""
        large = np.flatnonzero(crowd > BLOCK_VECTORS)
        blocks = -(-crowd[large] // BLOCK_VECTORS)
        small = np.where(crowd > BLOCK_VECTORS, 0, crowd) * each
        total = int(small.sum() + (crowd[large] * blocks * each).sum())
        turns = max(1, int(np.ceil(total / turn_bytes)))
        of_part = max(1, min(PART_BYTES, total // (4 * partitions * turns)))
        part = (np.cumsum(small) - small) // of_part
        part[crowd == 0] = part[large] = -1
        squared = blocks * blocks
        return Plan(part.astype(np.int64), large, blocks, int(part.max(initial=0)) + 1 + np.cumsum(squared) - squared, turns)

    def copies(self, keys: np.ndarray, node: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
        """Row, part and side of the copies of one turn. Sides: 0 all are compared, 1 with 2. A part gets one copy, however many of its cells a vector lies in."""
        row, at = np.nonzero(((self.part >= 0) & (self.part % self.turns == turn))[keys])
        row, part = np.divmod(np.unique(row * (int(self.part.max()) + 1) + self.part[keys[row, at]]), int(self.part.max()) + 1)
        out = [(row, part, np.zeros(len(row), np.int32))]
        if len(self.large):
            place = np.searchsorted(self.large, keys).clip(max=len(self.large) - 1)
            row, at = np.nonzero(self.large[place] == keys)
            place = place[row, at]
            n = self.blocks[place]
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, place, n = (np.repeat(v, n) for v in (row, place, n))
            own = node[row] % n                                         # ids of a task ascend, and so are dealt evenly
            part = self.first[place] + np.minimum(own, other) * n + np.maximum(own, other)
            side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int32)
            now = part % self.turns == turn
            out.append((row[now], part[now], side[now]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def inside(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of a part that vectors lie in: row and cell."""
        if part > self.part.max():
            cell = self.large[np.searchsorted(self.first, part, "right") - 1]
            return np.arange(len(keys)), np.full(len(keys), cell)
        row, at = np.nonzero(self.part[keys] == part)
        return row, keys[row, at]


def dealt(packs: DataFrame, index: Tables, plan: Plan, turn: int, kind: str) -> DataFrame:
    """The copies of one turn: ``part``, ``side``, ``size``, and as bytes ``node``, ``copies``, ``vector``, ``places``."""
    columns = ["node", "copies", "vector", "places"]

    def written(size: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        part, side, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((side, part))
        part, side = part[order], side[order]
        begin = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (side[1:] != side[:-1])))
        ends = np.append(begin, len(part))
        blobs = []
        for values in rest:
            data = np.ascontiguousarray(values[order])
            offsets = (ends * (data.nbytes // len(data))).astype(np.int32)
            blobs.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]))
        sizes = pa.array(np.full(len(begin), size, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(side[begin]), sizes, *blobs], ["part", "side", "size", *columns])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held, last = [], 0, None
        for batch in batches:
            for i, size in enumerate(batch.column("size").to_pylist()):
                if held and (size != last or bytes_held > GATHER_BYTES):
                    yield written(last, held)
                    held, bytes_held = [], 0
                last = size
                node, copies = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("node", "copies"))
                vector = np.frombuffer(batch.column("vector")[i].as_buffer(), kind).reshape(len(node), size)
                places = np.frombuffer(batch.column("places")[i].as_buffer(), index.kind).reshape(len(node), -1)
                step = max(1, GATHER_BYTES // (index.visits * (vector.itemsize * size + 100)))
                for done in range(0, len(node), step if len(plan.large) else len(node)):
                    some = slice(done, done + step if len(plan.large) else None)
                    row, part, side = plan.copies(index.keys(places[some]), node[some], turn)
                    if len(row):
                        row = row + done
                        held.append([part, side, node[row], copies[row], vector[row], places[row]])
                        bytes_held += sum(x.nbytes for x in held[-1])
                    if bytes_held > GATHER_BYTES:
                        yield written(last, held)
                        held, bytes_held = [], 0
        if held:
            yield written(last, held)

    return packs.mapInArrow(deal, "part bigint, side int, size int, node binary, copies binary, vector binary, places binary")


class Comparison:
    """Links among vectors of one length, each counted in the first cell that its vectors have in common."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, threshold: float) -> None:
        self.x, self.narrow, self.keys, self.threshold = x, x.astype(np.float32), keys, threshold
        self.doubt = (x.shape[1] + 16) * 1.2e-7                         # more than single precision can be wrong by

    def links(self, rows: np.ndarray, others: np.ndarray, key: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of ``rows`` with ``others`` (if ``same``, those after each row in the same list) that no cell before ``key`` counts."""
        done, before = 0, None
        while done < len(rows):
            begin, beyond = done, others[done:] if same else others
            part = rows[done: done + int(np.clip(min(PAIRS // max(1, len(beyond)), max(512, len(rows) // 4)), 1, BLOCK_QUERIES))]
            done += len(part)
            near = self.narrow[part] @ self.narrow[beyond].T
            mask = near >= self.threshold - self.doubt
            n = np.count_nonzero(mask)
            if n == 0 or same and n == len(part) and self.threshold <= 1:   # nothing, or each row with itself
                continue
            exact = False
            if n > 8 * len(part):                                       # too many pairs to look at each
                before = before or self.before(rows, others, key)
                exact = before[0]
                for ours, theirs in before[1]:
                    mask &= ours[begin:done] @ theirs[begin if same else 0:].T == 0
                    if not mask.any():
                        break
            a, b = np.nonzero(mask)
            if same:
                a, b = a[b > a], b[b > a]
            certain = near[a, b] >= self.threshold + self.doubt
            a, b = part[a], beyond[b]
            unsure = np.flatnonzero(~certain)
            for some in range(0, len(unsure), 1 << 14):
                at = unsure[some: some + (1 << 14)]
                certain[at] = (self.x[a[at]] * self.x[b[at]]).sum(axis=1) >= self.threshold
            a, b = a[certain], b[certain]
            for some in range(0, len(a), 1 << 14):
                i, j = a[some: some + (1 << 14)], b[some: some + (1 << 14)]
                if exact:
                    yield i, j
                    continue
                ours = self.keys[i]
                counted = ~(np.where(ours < key, ours, -1)[:, :, None] == self.keys[j][:, None, :]).any(axis=(1, 2))
                yield i[counted], j[counted]

    def before(self, rows: np.ndarray, others: np.ndarray, key: int) -> tuple[bool, list[tuple[np.ndarray, np.ndarray]]]:
        """Which of the cells before ``key`` each one lies in, as columns of ones, 512 cells a matrix, those of most vectors first; and whether that is all such cells."""
        ours, theirs = self.keys[rows], self.keys[others]
        found, n = np.unique(theirs[theirs < key], return_counts=True)
        most = max(512, (1 << 24) // max(len(rows), len(others)))
        some = found[np.argsort(-n, kind="stable")][:most]

        def lies_in(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
            place = np.searchsorted(cells, keys).clip(max=len(cells) - 1)
            row, at = np.nonzero(cells[place] == keys)
            out = np.zeros((len(keys), len(cells)), np.float32)
            out[row, place[row, at]] = 1
            return out

        parts = [np.sort(some[done: done + 512]) for done in range(0, len(some), 512)]
        return len(found) <= most, [(lies_in(ours, cells), lies_in(theirs, cells)) for cells in parts]


def compared(copies: DataFrame, index: Tables, plan: Plan, threshold: float, kind: str) -> DataFrame:
    """``node``, ``n`` (linked copies found), ``other`` (null, or a node linked with this one) from all parts of a turn."""
    def compare(group: pa.Table) -> pa.Table:
        nodes, counts, roots, sizes = [], [], [], group.column("size").to_numpy()
        for size in np.unique(sizes):
            rows = group.filter(pa.array(sizes == size))
            whole = lambda name, kind, rows=rows: np.frombuffer(b"".join(x.as_buffer() for x in rows.column(name)), kind)
            (node, mine), copies = np.unique(whole("node", "<i8"), return_inverse=True), whole("copies", "<i8")
            side = np.repeat(rows.column("side").to_numpy(), [len(x.as_buffer()) // 8 for x in rows.column("node")])
            keys = index.keys(whole("places", index.kind).reshape(len(mine), -1))
            work = Comparison(unit(whole("vector", kind).reshape(len(mine), size).astype(float)), keys, threshold)
            found, edges, held = np.zeros(len(node), np.int64), [], []

            def count(found=found, edges=edges, held=held, mine=mine, node=node, copies=copies) -> None:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                one, two = mine[a], mine[b]
                found += (np.bincount(one, copies[b], len(node)) + np.bincount(two, copies[a], len(node))).astype(np.int64)
                root = forest(len(node), one, two)
                at = np.flatnonzero(root != np.arange(len(node)))
                edges.append((at, root[at]))
                held.clear()

            def jobs(keys=keys, side=side) -> Iterator[tuple]:
                row, key = plan.inside(group.column("part")[0].as_py(), keys)
                if side.any():
                    yield np.flatnonzero(side == 1), np.flatnonzero(side == 2), int(key[0]), False
                    return
                order = key.argsort(kind="stable")
                row, key = row[order], key[order]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                for a, b in zip(begin, np.append(begin[1:], len(key)), strict=True):
                    if b - a > 1:
                        yield row[a:b], row[a:b], int(key[a]), True

            for job in jobs():
                for links in work.links(*job):
                    if len(links[0]):
                        held.append(links)
                if sum(len(a) for a, _ in held[-64:]) > PAIRS or len(held) > 4096:
                    count()
            if held:
                count()
            root = forest(len(node), *(np.concatenate(x) for x in zip(*edges, strict=True))) if edges else np.arange(len(node))
            take = np.flatnonzero(found)
            nodes.append(node[take])
            counts.append(found[take])
            roots.append(node[root[take]])
        return pa.table([pa.array(np.concatenate(x)) for x in (nodes, counts, roots)], ["node", "n", "other"])

    return copies.groupBy("part").applyInArrow(compare, "node bigint, n bigint, other bigint")


def clear_away(spark: SparkSession, wait: float = 0) -> None:
    """Have Spark delete what nothing refers to any more. Some objects go at a second collection only, and the cleaner works beside the jobs: ``wait`` gives it seconds."""
    for _ in range(2):
        gc.collect()
        let_go(spark)
        time.sleep(wait)


def linked(packs: DataFrame, index: Tables, threshold: float, kind: str, folder: str) -> DataFrame:
    """``node``, ``n``, ``other`` of all cells, in as many turns as the copies need, written to ``folder``."""
    spark, schema = packs.sparkSession, "node bigint, n bigint, other bigint"
    crowd, item = crowds(packs, index), np.dtype(kind).itemsize
    vectors, amount = packs.agg(F.sum(F.octet_length("node") / 8).cast("bigint"), F.sum(F.octet_length("vector").cast("bigint"))).first()
    each = int(amount / vectors + index.visits * np.dtype(index.kind).itemsize + 20)
    plan = Plan.of(crowd, each, max(TURN_BYTES, TURN_SHARE * amount), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for turn in range(plan.turns):
        compared(dealt(packs, index, plan, turn, kind), index, plan, threshold, kind).write.mode("append").parquet(folder)
        if plan.turns > 1:
            clear_away(spark, 0.5)
    return spark.read.schema(schema).parquet(folder)


def near_duplicates(table: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.9, recall: float = 0.999, sample: int = 20_000,
                    queries: int = 1_000, per_cell: int = 48, largest: int = 256, least: int = 4) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest key reachable), ``kept``.

    ``recall``: the share of the sample queries with links in other cells that meet them all in the cells visited.
    ``least``: cells visited at least, over all tables. ``per_cell``: vectors in a cell, about, if each lay in one, until the codebooks reach ``largest`` codewords.
    """
    kind = "<f4" if table.select(F.col(vector).alias("v")).schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = table.select(F.col(key).alias("vec_id"), F.when(good, v).alias("vector"))
    hashed = rows.where("vector is not null").select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    nodes = kept(hashed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("vector").alias("vector")).withColumn(
        "node", F.monotonically_increasing_id()))
    clear_away(table.sparkSession)
    index = fit(nodes, threshold, recall, sample, queries, per_cell, largest, least)
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if index is None:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    packs = kept(packed(nodes, index, kind))
    nodes = kept(nodes.drop("vector"))                                  # the vectors lie in the packs now
    clear_away(table.sparkSession)
    folder = new_folder(table.sparkSession, "links")
    found = linked(packs, index, threshold, kind, folder)
    del packs
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(count, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = kept(known)
    remove_folder(table.sparkSession, folder)
    every = hashed.drop("vector").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
