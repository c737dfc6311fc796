"""Passages that occur more than once: removed wherever they stand, located by automata.

A window is ``window`` consecutive words of a text; it repeats if the same words start anywhere else. Every word of a repeating window goes.

1. Texts are packed into parts of about ``PART`` bytes, kept in the shared folder.
2. Each window names the run of ``ANCHOR`` words in it with the smallest hash, its anchor. Equal windows have equal anchors, so only windows
   around an anchor that occurs twice can repeat. Neighbouring windows with one anchor are a region, some fifty words; a part tells
   the shuffle each different region (anchor, hash of its words) once.
3. Passages are confirmed. A region that occurs twice repeats as a whole. Where an anchor stands in different regions, the windows of those
   that occur once are counted, each different region of the others beside them only once.
4. The parts get their confirmed regions and windows back. In each part the maximal passages are compiled into Aho-Corasick automata, of
   ``AUTOMATON`` words at most, over the numbers of the part's own words; all texts of the part are streamed through them, and every
   occurrence found is removed. So an automaton only has passages that its texts can hold, and compares words, not hashes.

Rows
    A null or empty text has no words. Repeated rows repeat each other. Equal and null keys give a row each. A very long text is a part of
    its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabulight.llm.flat import SPACE, flat_text, mix, runs, tidied
from tabulight.llm.pieces import spread
from tabulight.llm.storage import kept, new_folder, remove_folder

#: Words of an anchor, bytes of text in a part, words compiled into an automaton.
ANCHOR, PART, AUTOMATON = 8, 4 << 20, 300_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: FACTOR times this is 1, modulo 2^64.
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def packed(docs: DataFrame, part_bytes: int) -> DataFrame:
    """``part``, ``keys``, ``sizes`` (bytes of each text) and ``texts`` (compressed, one after the other) for rows of ``key``, ``text``."""
    kind = docs.schema["key"].dataType.simpleString()

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def part() -> pa.RecordBatch:
            keys = pa.chunked_array([k for k, _, _ in held]).combine_chunks()
            keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
            sizes, raw = np.concatenate([np.diff(o) for _, _, o in held]), b"".join(d.tobytes() for _, d, _ in held)
            one = pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.ListArray.from_arrays(one, keys), pa.ListArray.from_arrays(one, pa.array(sizes)),
                                               pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], ["part", "keys", "sizes", "texts"])

        for batch in batches:
            data, offsets = flat_text(batch.column("text"))
            first, n = 0, batch.num_rows
            while first < n:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + part_bytes - size, "right")) - 1)
                held.append((batch.column("key").slice(first, last - first), data[offsets[first]: offsets[last]].copy(), offsets[first: last + 1]))
                size += int(offsets[last] - offsets[first])
                first = last
                if size >= part_bytes or first < n:
                    yield part()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield part()

    return docs.mapInArrow(pack, f"part bigint, keys array<{kind}>, sizes array<bigint>, texts binary")


def dealt(parts: DataFrame) -> DataFrame:
    """The parts, kept as they are dealt by ``part``, so that groupings by it shuffle the texts no more."""
    conf = parts.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")                 # an adaptive plan does not tell how its rows are dealt
    try:
        return kept(parts.repartition(int(conf.get("spark.sql.shuffle.partitions")), "part"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


class Words:
    """The words of a part: their places, their numbers among the part's different words, a hash of each."""

    def __init__(self, sizes: np.ndarray, texts: pa.Buffer):
        import xxhash

        self.sizes = sizes
        raw = pa.decompress(texts, int(sizes.sum()), "zstd") if sizes.sum() else b""
        self.data = np.frombuffer(raw, np.uint8)
        inside = ~SPACE[self.data]
        self.starts, self.ends, self.first = runs(inside, np.concatenate([[0], np.cumsum(sizes)]))
        length = self.ends - self.starts
        place = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(place.tobytes()), pa.py_buffer(self.data[inside])]).dictionary_encode()
        self.number, self.different = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, self.different)
        self.hash = own[self.number] if len(length) else own


class Windows:
    """Windows and regions of a part. ``start``: each window's first word, ``region``: its region, ``anchor``, ``hash`` of its words."""

    def __init__(self, words: Words, window: int, anchor: int):
        import xxhash

        n, count = len(words.hash), np.maximum(0, np.diff(words.first) - window + 1)
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(n, f))) for f in (FACTOR, INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * power[:n])])
        run = lambda size: (sums[size:] - sums[:-size]) * back[: n + 1 - size] if n >= size else np.zeros(0, np.uint64)
        self.start = spread(words.first[:-1], count)
        owner = np.repeat(np.arange(len(count)), count)
        self.hash = mix(run(window)[self.start])
        low, at, have, wanted = mix(run(anchor)), np.arange(max(0, n - anchor + 1)), 1, window - anchor + 1
        while have < wanted and len(low):                           # smallest of ``have`` neighbours, the first of equal ones
            step = min(have, wanted - have)
            if len(low) <= step:
                low, at = low[:0], at[:0]
                break
            later = low[step:] < low[:-step]
            low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
            have += step
        self.anchor, at = low[self.start], at[self.start]
        new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])) if len(at) else np.zeros(0, bool)
        self.region = np.cumsum(new) - 1
        self.opens = np.flatnonzero(new)
        last = np.append(self.opens[1:], len(new)) - 1 if len(new) else self.opens
        raw, digest = memoryview(words.hash.tobytes()), xxhash.xxh3_64_intdigest
        bounds = zip((8 * self.start[self.opens]).tolist(), (8 * (self.start[last] + window)).tolist(), strict=True)
        self.region_hash = np.fromiter((digest(raw[a:b]) for a, b in bounds), np.uint64, len(self.opens))
        self.region_anchor = self.anchor[self.opens]


PAIR = np.dtype([("v", np.uint64), ("h", np.uint64)])


def as_pairs(v: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.empty(len(v), PAIR)
    out["v"], out["h"] = v, h
    return out


def member(v: np.ndarray, h: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each pair is among the sorted ones."""
    if not len(among):
        return np.zeros(len(v), bool)
    order = np.argsort(among["h"], kind="stable")
    keys, values = among["h"][order], among["v"][order]
    place = np.searchsorted(keys, h)
    out, live = np.zeros(len(v), bool), np.arange(len(v))
    while len(live):                                                # hashes are nearly always different, so this is one turn
        live = live[place[live] < len(keys)]
        live = live[keys[place[live]] == h[live]]
        same = values[place[live]] == v[live]
        out[live[same]] = True
        live = live[~same]
        place[live] += 1
    return out


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def part_regions(parts: DataFrame, window: int, anchor: int) -> DataFrame:
    """``v`` (anchor), ``h`` (region), ``part``, ``n``: each part's different regions."""
    @tidied
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                found = Windows(Words(batch.column("sizes")[i].values.to_numpy(), batch.column("texts")[i].as_buffer()), window, anchor)
                order = np.lexsort((found.region_hash, found.region_anchor))
                v, h = found.region_anchor[order], found.region_hash[order]
                edge = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (h[1:] != h[:-1]))) if len(v) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([signed(v[edge]), signed(h[edge]), pa.array(np.full(len(edge), part)), pa.array(np.diff(np.append(edge, len(v))))], ["v", "h", "part", "n"])

    return parts.select("part", "sizes", "texts").mapInArrow(regions, "v bigint, h bigint, part bigint, n bigint")


def grouped_pairs(rows: pa.Table, kind: int) -> np.ndarray:
    own = rows.filter(pc.equal(rows.column("kind"), kind))
    return as_pairs(own.column("v").to_numpy().view(np.uint64), own.column("h").to_numpy().view(np.uint64))


def confirmed(parts: DataFrame, window: int, anchor: int) -> DataFrame:
    """``part``, ``kind``, ``v``, ``h``: the regions (kind 0) and, in other regions, the windows (kind 1) of a part that repeat."""
    spark = parts.sparkSession
    folder = new_folder(spark, "regions")                           # in columns a third of a checkpoint's bytes
    part_regions(parts, window, anchor).write.parquet(folder)
    rows = spark.read.parquet(folder)
    anchors = rows.groupBy("v").agg(F.sum("n").alias("all"), (F.min("h") != F.max("h")).alias("mixed")).where("all > 1").select("v", "mixed")
    shared = kept(rows.join(anchors, "v"))
    remove_folder(spark, folder)
    mixed = shared.where("mixed").select("v", "h", "part", "n")
    counts = mixed.groupBy("v", "h").agg(F.sum("n").alias("all"), F.min("part").alias("one"))
    known = kept(mixed.join(counts, ["v", "h"]).select("v", "h", "part", (F.col("all") > 1).alias("twice"), (F.col("part") == F.col("one")).alias("first")))
    whole = shared.where("not mixed").select("part", "v", "h").unionByName(known.where("twice").select("part", "v", "h"))
    asked = known.where("first").select(F.col("part").alias("of_part"), "v", "h", F.col("twice").cast("int").alias("kind"))

    def windows(own: pa.Table, regions: pa.Table) -> pa.Table:
        if not (own.num_rows and regions.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("v", "h", "part", "n")})
        found = Windows(Words(pc.list_flatten(own.column("sizes")).to_numpy(), own.column("texts")[0].as_buffer()), window, anchor)
        weight = np.zeros(len(found.opens), np.int64)
        for kind in (0, 1):                                         # a region that occurs twice counts for two
            weight[member(found.region_anchor, found.region_hash, grouped_pairs(regions, kind))] = kind + 1
        _, one = np.unique(as_pairs(found.region_anchor, found.region_hash), return_index=True)
        once = np.zeros(len(weight), bool)
        once[one] = True
        weight = (weight * once)[found.region]
        take = np.flatnonzero(weight)
        return pa.table({"v": signed(found.anchor[take]), "h": signed(found.hash[take]), "part": pa.array(np.full(len(take), own.column("part")[0].as_py())), "n": pa.array(weight[take])})

    listed = kept(parts.select("part", "sizes", "texts").groupBy("part").cogroup(asked.groupBy("of_part")).applyInArrow(windows, "v bigint, h bigint, part bigint, n bigint"))
    repeated = listed.groupBy("v", "h").agg(F.sum("n").alias("all")).where("all > 1").select("v", "h")
    inner = listed.where("n = 1").join(repeated, ["v", "h"]).select("part", "v", "h")
    return whole.select("part", F.lit(0).alias("kind"), "v", "h").unionByName(inner.select("part", F.lit(1).alias("kind"), "v", "h"))


def spell(number: np.ndarray, different: int) -> tuple[bytes, int]:
    """A text of ``width`` signs for each word number; signs of different places differ, so matches only begin at words."""
    width = 1
    while 64 ** width < different:
        width += 1
    signs = np.empty((len(number), width), np.uint8)
    for k in range(width):
        signs[:, k] = (number >> 6 * k & 63) + 64 * min(k, 2)
    return signs.tobytes(), width


def located(number: np.ndarray, different: int, first: np.ndarray, spans: list[tuple[int, int]], window: int, limit: int) -> np.ndarray:
    """Whether each word lies in an occurrence of a passage; ``spans``: words that the passages are taken from; ``first``: texts' first words."""
    import ahocorasick

    raw, width = spell(number, different)
    text = raw.decode("latin-1")
    chunks = []
    for a, b in spans:                                              # a passage longer than an automaton is cut
        edges = [*range(a, max(a + 1, b - max(limit, window) + 1), max(limit, window)), b]
        edges[-2] = min(edges[-2], b - window) if len(edges) > 2 else edges[-2]
        chunks += zip(edges[:-1], edges[1:], strict=True)
    passages = {text[width * a: width * b]: b - a for a, b in chunks}
    stream = "\xff".join(text[width * a: width * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    change, held, size = np.zeros(len(number) + 1, np.int64), [], 0
    for passage, words in [*passages.items(), (None, 0)]:
        if held and (passage is None or size + words > limit):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for own, n in held:
                automaton.add_word(own, n)
            automaton.make_automaton()
            found = np.fromiter((x for match in automaton.iter(stream) for x in match), np.int64).reshape(-1, 2)
            text_of = np.searchsorted(width * first[1:] + np.arange(len(first) - 1), found[:, 0], "right")
            last = (found[:, 0] + 1 - text_of) // width             # a separator stands before each text but the first
            np.add.at(change, last - found[:, 1], 1)
            np.add.at(change, last, -1)
            held, size = [], 0
        if passage is not None:
            held.append((passage, words))
            size += words
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 35, anchor: int = ANCHOR, part_bytes: int = PART, automaton: int = AUTOMATON) -> DataFrame:
    """One row per text: its key, ``n_words``, ``n_removed``, and ``kept``: the words outside repeating windows, one space apart."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = dealt(packed(rows, part_bytes))
    told = confirmed(parts, window, anchor).withColumnRenamed("part", "of_part")
    kind = rows.schema["key"].dataType.simpleString()

    def remove(own: pa.Table, repeats: pa.Table) -> pa.Table:
        words = Words(pc.list_flatten(own.column("sizes")).to_numpy(), own.column("texts")[0].as_buffer())
        gone = np.zeros(len(words.hash), bool)
        if repeats.num_rows:
            found = Windows(words, window, anchor)
            hit = member(found.region_anchor, found.region_hash, grouped_pairs(repeats, 0))[found.region] | member(found.anchor, found.hash, grouped_pairs(repeats, 1))
            start = found.start[hit]
            text_of = np.searchsorted(words.first, start, "right")
            opens = np.flatnonzero(np.append(True, (start[1:] != start[:-1] + 1) | (text_of[1:] != text_of[:-1]))) if len(start) else np.zeros(0, np.int64)
            ends = start[np.append(opens[1:], len(start)) - 1] + window if len(start) else start
            spans = list(zip(start[opens].tolist(), ends.tolist(), strict=True))
            gone = located(words.number, words.different, words.first, spans, window, automaton) if spans else gone
        n_words, removed = np.diff(words.first), np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[words.first[1:]] - removed[words.first[:-1]]
        stay = np.flatnonzero(~gone)
        size = words.ends[stay] - words.starts[stay] + 1                # with a space behind each word
        joined = words.data[np.minimum(spread(words.starts[stay], size), max(len(words.data) - 1, 0))] if len(stay) else np.zeros(0, np.uint8)
        total = np.concatenate([[0], np.cumsum(size)])
        joined[total[1:] - 1] = 0x20
        at = total[np.searchsorted(stay, words.first)]
        raw = joined.tobytes()
        texts = pa.array([raw[a: max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        return pa.table({"key": pc.list_flatten(own.column("keys")).combine_chunks(), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept": texts})

    found = parts.groupBy("part").cogroup(told.groupBy("of_part")).applyInArrow(remove, f"key {kind}, n_words bigint, n_removed bigint, kept string")
    return found.withColumnRenamed("key", key)
