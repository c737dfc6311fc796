"""Divergence of sources: how the words of each source differ from those of its language's other sources, and which words stand out.

Terms are runs of letters and characters beyond ASCII, A-Z lowered. A language keeps the terms that enough of its documents have. They are
sorted and compiled into minimal acyclic transducers: automata without a state more than needed, whose edges carry numbers that add
up to a term's place in the sorted list (its ordinal). The texts are then read again and streamed through the transducers, which
count the kept terms by ordinal, (language, source) by (language, source). From then on a term is its ordinal, which also breaks ties; the
few terms of the result are spelled from their ordinals by the same transducers.

A transducer has at most ``SHARD`` terms of one language. Tasks build them side by side from sorted ranges of terms; a pass over the texts
takes as many as fit in ``WAVE`` bytes (some ten million terms), so what is broadcast has a bound, and a larger vocabulary takes more passes.

Rows
    Null text, language and source count as ''. A group without kept terms takes part with counts of zero; a language that keeps no
    term gives pairs of value 0 and no terms. Long texts are read in pieces of whole texts, repeated rows count each time, an empty table
    gives an empty result, other columns are not read. Counts of a group may reach 9 x 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulight.llm.flat import flat_text, pieces, runs, tidied
from tabulight.llm.storage import kept

SCALE = 1_000_000_000
SHARD, WAVE = 200_000, 64 << 20
#: Bytes of text looked at together; counts that a task holds before it merges them.
PIECE, HELD = 4 << 20, 2 << 20
#: Terms and sources of a block of the comparison between sources.
BLOCK, TILE = 1024, 64
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def sorted_counts(values: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs (or the sum of its weights)."""
    order = np.argsort(values, kind="stable") if weight is not None else None
    ordered = np.sort(values) if order is None else values[order]
    edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, np.int64)
    total = np.diff(np.append(edge, len(values))) if order is None else np.add.reduceat(weight[order], edge) if len(edge) else weight
    return ordered[edge], total


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms of some texts (as bytes), the place of every occurrence among them, and its text."""
    inside = TERM[data]
    starts, ends, first = runs(inside, offsets)
    low = data[inside]
    low = np.where((low >= 0x41) & (low <= 0x5A), low + 32, low).astype(np.uint8)
    place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place.tobytes()), pa.py_buffer(low)])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first))


class Transducer:
    """A minimal acyclic automaton of sorted terms. The numbers on a term's edges add up to its place in the list."""

    def __init__(self, words: list[bytes]):
        known: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([], [False])]             # the states of the last word: edges, and whether a word ends
        last = b""

        def freeze(depth: int) -> None:
            """States below ``depth`` get no more edges: an equal one takes their place."""
            while len(path) > depth + 1:
                edges, end = path.pop()
                path[-1][0][-1] = (path[-1][0][-1][0], known.setdefault((end[0], *edges), len(known)))

        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            freeze(same)
            for byte in word[same:]:
                path[-1][0].append((byte, -1))
                path.append(([], [False]))
            path[-1][1][0] = True
            last = word
        freeze(0)
        states = [*known, (path[0][1][0], *path[0][0])]             # children come before their parents, the start comes last
        below, keys, target, output = [], [], [], []
        for state, (end, *edges) in enumerate(states):
            total = int(end)
            for byte, child in edges:
                keys.append(state << 8 | byte)
                target.append(child)
                output.append(total)
                total += below[child]
            below.append(total)
        self.start, self.size = len(states) - 1, below[-1]
        self.final = np.array([s[0] for s in states], bool)
        self.keys, self.target, self.output = np.array(keys, np.int64), np.array(target, np.int32), np.array(output, np.int32)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each span of bytes, -1 for those that are no term; all spans take their steps side by side."""
        out, state = np.zeros(len(starts), np.int64), np.full(len(starts), self.start, np.int64)
        live, step = np.arange(len(starts)), 0
        while len(live) and len(self.keys):
            live = live[starts[live] + step < ends[live]]
            key = state[live] << 8 | data[starts[live] + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[place] == key
            state[live] = np.where(there, self.target[place], -1)
            live, place = live[there], place[there]
            out[live] += self.output[place]
            step += 1
        return np.where((state >= 0) & self.final[state], out, -1) if len(self.keys) else np.full(len(starts), -1)

    def spell(self, ordinal: int) -> bytes:
        """The term at a place of the sorted list."""
        state, word = self.start, bytearray()
        while not (self.final[state] and ordinal == 0):
            first, last = np.searchsorted(self.keys, [state << 8, state + 1 << 8])
            edge = first + int(np.searchsorted(self.output[first:last], ordinal, "right")) - 1
            word.append(int(self.keys[edge]) & 0xFF)
            ordinal -= int(self.output[edge])
            state = int(self.target[edge])
        return bytes(word)

    def to_bytes(self) -> bytes:
        parts = (np.array([len(self.keys), len(self.final), self.size], np.int64), self.keys, self.target, self.output, self.final)
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        new = cls.__new__(cls)
        edges, states, new.size = np.frombuffer(raw, np.int64, 3).tolist()
        new.start, at = states - 1, 24
        for name, kind, n in (("keys", np.int64, edges), ("target", np.int32, edges), ("output", np.int32, edges), ("final", bool, states)):
            setattr(new, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return new


def strings(frame: DataFrame, *columns: str) -> DataFrame:
    """The columns as text, null as ''."""
    return frame.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in zip(("lang", "source", "text"), columns, strict=False)))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """``lang``, ``term`` of the terms that occur in ``least`` or more documents of the language; docs: ``lang``, ``text``."""
    @tidied
    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            lang, done = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0
            for data, offsets in pieces(*flat_text(batch.column("text")), PIECE):
                found, code, owner = terms(data, offsets)
                n = max(len(found), 1)
                once, _ = sorted_counts(owner * n + code)
                pair, docs_with = sorted_counts(lang[done + once // n] * n + once % n)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(pair // n)).cast(pa.string()), found.take(pa.array(pair % n)).cast(pa.large_string()).cast(pa.string()),
                                                  pa.array(docs_with)], ["lang", "term", "n"])
                done += len(offsets) - 1

    found = docs.select("lang", "text").mapInArrow(occurring, "lang string, term string, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def compiled(vocabulary: DataFrame, shard: int) -> DataFrame:
    """Transducers of ``shard`` terms at most: ``part``, ``seq`` (both ascending in the order of the terms), ``lang``, ``n``, ``automaton``."""
    parts = max(1, -(-vocabulary.count() // shard))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, lang, held = TaskContext.get().partitionId(), 0, None, []

        def packed() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "lang": lang, "n": len(held), "automaton": Transducer(held).to_bytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("automaton", pa.binary())]))

        for batch in batches:
            for own, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if held and (own != lang or len(held) == shard):
                    yield packed()
                    seq, held = seq + 1, []
                lang = own
                held.append(term.encode())
        if held:
            yield packed()

    ordered = vocabulary.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(build, "part int, seq int, lang string, n bigint, automaton binary")


class Vocabulary:
    """The transducers of all languages, kept in the shared folder, and the place of each in its language."""

    def __init__(self, docs: DataFrame, least: int, shard: int, wave: int):
        self.table = kept(compiled(kept(kept_terms(docs, least)), shard))
        self.size: dict[str, int] = {}
        self.waves: list[dict[tuple[int, int], tuple[str, int]]] = []
        filled = wave
        for part, seq, lang, n, size in self.table.select("part", "seq", "lang", "n", F.octet_length("automaton")).orderBy("part", "seq").collect():
            if filled + size > wave:
                self.waves.append({})
                filled = 0
            self.waves[-1][part, seq] = (lang, self.size.get(lang, 0))
            filled += size
            self.size[lang] = self.size.get(lang, 0) + n

    def broadcast(self, wave: dict[tuple[int, int], tuple[str, int]]):
        """To every task: language -> (first ordinal, transducer), of one wave."""
        low, high = min(wave), max(wave)
        spot = F.struct("part", "seq")
        rows = self.table.where(spot.between(F.struct(F.lit(low[0]), F.lit(low[1])), F.struct(F.lit(high[0]), F.lit(high[1])))).select("part", "seq", "automaton").collect()
        found: dict[str, list[tuple[int, bytes]]] = {}
        for part, seq, raw in rows:
            lang, first = wave[part, seq]
            found.setdefault(lang, []).append((first, bytes(raw)))
        return self.table.sparkSession.sparkContext.broadcast(found)


def recounted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``lang``, ``source``, ``ordinal``, ``n`` > 0: the kept terms in the texts of each group, found by the transducers."""
    passes = []
    for wave in vocabulary.waves:
        sent = vocabulary.broadcast(wave)

        @tidied
        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machines = {lang: [(first, Transducer.from_bytes(raw)) for first, raw in own] for lang, own in sent.value.items()}
            span = 1 + max((first + m.size for own in machines.values() for first, m in own), default=0)
            place: dict[tuple[str, str], int] = {}
            keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for batch in batches:
                both = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
                group, done = np.array([place.setdefault(b, len(place)) for b in both], np.int64), 0
                for data, offsets in pieces(*flat_text(batch.column("text")), PIECE):
                    found, code, owner = terms(data, offsets)
                    raw, edges = np.frombuffer(found.buffers()[2] or b"", np.uint8), np.frombuffer(found.buffers()[1], np.int64)[found.offset: found.offset + len(found) + 1]
                    mine = group[done: done + len(offsets) - 1]
                    for lang in {both[done + i][0] for i in range(len(mine))} & set(machines):
                        ordinal = np.full(len(found), -1, np.int64)
                        for first, machine in machines[lang]:
                            at = machine.ordinals(raw, edges[:-1], edges[1:])
                            ordinal = np.where(at >= 0, first + at, ordinal)
                        speaks = np.array([both[done + i][0] == lang for i in range(len(mine))], bool)
                        hit = ordinal[code]
                        inner = (hit >= 0) & speaks[owner]
                        key, n = sorted_counts(mine[owner[inner]] * span + hit[inner])
                        keys.append(key)
                        counts.append(n)
                        held += len(key)
                    done += len(offsets) - 1
                    if held > HELD:
                        key, n = sorted_counts(np.concatenate(keys), np.concatenate(counts))
                        keys, counts, held = [key], [n], 0
            key, n = sorted_counts(np.concatenate(keys), np.concatenate(counts))
            names = list(place)
            langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            for first in range(0, len(key), 1 << 17):
                own = key[first: first + (1 << 17)]
                which = pa.array(own // span)
                yield pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), pa.array(own % span), pa.array(n[first: first + (1 << 17)])], ["lang", "source", "ordinal", "n"])

        passes.append(docs.mapInArrow(count, "lang string, source string, ordinal bigint, n bigint").groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))
    if not passes:
        return docs.sparkSession.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def level(n: Column, total: Column, size: Column) -> Column:
    """p = 1 + floor(SCALE x (n + 2) / (total + 2 x size)), exact."""
    whole = F.expr(f"cast({SCALE} as decimal(10,0))") * (n + 2).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", whole, (total + 2 * size).cast("decimal(19,0)"))


def levels(n: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """The same in numpy: a long division in three steps of a factor 1,000, so that no product leaves 64 bits."""
    rest, whole, by = n + 2, np.zeros_like(n), total + 2 * size
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // by
        rest = rest % by
    return 1 + whole


def differing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_values(counts: DataFrame, groups: DataFrame, block: int, tile: int) -> DataFrame:
    """``lang``, ``a``, ``b`` (places of sources, a < b), ``value``: the differences of two sources, summed over all kept terms.

    The table of sources and terms is cut into blocks of terms and tiles of sources. A task gets a block and two tiles, whatever the number of
    sources and terms; a source is in each block of its language by a row with its total.
    """
    sides = groups.where("size > 0").select("lang", "source", "place", "total", "size", (F.expr(f"div(max(place) OVER (PARTITION BY lang), {tile})")).alias("last_tile"))
    rows = counts.join(sides, ["lang", "source"]).select("lang", "place", "last_tile", "size", F.expr(f"div(ordinal, {block})").alias("block"), "ordinal", "n", F.lit(None).cast("bigint").alias("total"))
    heads = sides.select("lang", "place", "last_tile", "size", F.explode(F.expr(f"sequence(0, div(size - 1, {block}))")).alias("block"), F.lit(None).cast("bigint").alias("ordinal"),
                         F.lit(0).cast("bigint").alias("n"), "total")
    both = rows.unionByName(heads).withColumn("own", F.expr(f"div(place, {tile})")).withColumn("other", F.explode(F.expr("sequence(0, last_tile)")))
    both = both.select("lang", "block", "place", "size", "ordinal", "n", "total", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"))

    def compare(batches: pa.Table) -> pa.Table:
        lang, at, t, u = (batches.column(c)[0].as_py() for c in ("lang", "block", "t", "u"))
        size = batches.column("size")[0].as_py()
        place, ordinal, n = (batches.column(c).to_numpy() for c in ("place", "ordinal", "n"))
        is_head = batches.column("total").is_valid().to_numpy()
        order = np.argsort(place[is_head])
        sources, totals = place[is_head][order], batches.column("total").to_numpy()[is_head].astype(np.int64)[order]
        width = min(block, size - at * block)
        table = np.zeros((len(sources), width), np.int64)
        table[np.searchsorted(sources, place[~is_head]), ordinal[~is_head].astype(np.int64) - at * block] = n[~is_head]
        p, own = levels(table, totals[:, None], size), sources // tile
        a, b, value = [], [], []
        for i in range(len(sources)):
            partner = np.flatnonzero((np.arange(len(sources)) > i) & ((own == u) & (own[i] == t)))
            a += [sources[i]] * len(partner)
            b += sources[partner].tolist()
            value += differing(p[partner], p[i]).sum(axis=1).tolist()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})

    found = both.groupBy("lang", "block", "t", "u").applyInArrow(compare, "lang string, a bigint, b bigint, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def spelled(top: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``item``, the term of ``lang`` and ``ordinal``, for a few rows."""
    out = None
    for wave in vocabulary.waves:
        sent = vocabulary.broadcast(wave)

        def spell(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machines = {lang: [(first, Transducer.from_bytes(raw)) for first, raw in own] for lang, own in sent.value.items()}
            for batch in batches:
                items = []
                for lang, ordinal in zip(batch.column("lang").to_pylist(), batch.column("ordinal").to_pylist(), strict=True):
                    items.append(next((m.spell(ordinal - first).decode() for first, m in machines.get(lang, ()) if first <= ordinal < first + m.size), None))
                full = batch.append_column("item", pa.array(items, pa.string()))
                yield full.filter(full.column("item").is_valid())

        found = top.mapInArrow(spell, "lang string, source string, ordinal bigint, value bigint, rank int, item string")
        out = found if out is None else out.unionByName(found)
    return top.withColumn("item", F.lit(None).cast("string")).limit(0) if out is None else out


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10, shard: int = SHARD, wave: int = WAVE,
          block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """One row per pair of sources of a language, and per term that stands out in a source.

    Columns ``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value``, ``rank``. With p the level of a kept term in the group, 1 + floor(10^9 (count + 2) /
    (N + 2 V)), and q that in the other source or in the whole language, a term's difference is floor((p - q)^2 / (p + q)). 'pair' has the
    sum over all V kept terms for each other source; 'term' the ``top`` terms of the group with p > q. Ranks go by value, then by item.
    """
    texts = strings(docs, lang, source, text)
    vocabulary = Vocabulary(texts, least, shard, wave)
    counts = kept(recounted(texts, vocabulary))
    sizes = docs.sparkSession.createDataFrame([*vocabulary.size.items()], "lang string, size bigint")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(F.broadcast(sizes), "lang", "left").select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("place"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    groups = kept(groups)
    by_value = Window.partitionBy("lang", "source")

    value = pair_values(counts, groups, block, tile)
    value = value.unionByName(value.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    left, right = groups.select("lang", "source", F.col("place").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = left.join(right, "lang").where("a <> b").join(value, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "item")))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    all_totals = counts.groupBy("lang").agg(F.sum("n").alias("all_total"))
    rows = counts.join(whole, ["lang", "ordinal"]).join(groups.select("lang", "source", "total", "size"), ["lang", "source"]).join(all_totals, "lang")
    rows = rows.select("lang", "source", "ordinal", level(F.col("n"), F.col("total"), F.col("size")).alias("p"), level(F.col("all_n"), F.col("all_total"), F.col("size")).alias("q"))
    rows = rows.where("p > q").select("lang", "source", "ordinal", F.expr("div((p - q) * (p - q), p + q)").alias("value"))
    best = rows.withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    items = spelled(best.select("lang", "source", "ordinal", "value", "rank"), vocabulary).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(items)
