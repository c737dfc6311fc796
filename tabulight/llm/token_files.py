"""Token ids in compressed files: canonical Huffman codes of limited length, from the counts of all ids.

A folder holds two Parquet tables. ``codes`` has the length of each id's code; canonical codes follow from lengths alone. ``blocks``, in
ascending order of the documents' keys from file to file and row to row, has blocks of whole documents, about ``BLOCK`` ids each,
that are decoded without any other block: the place of the first id among all ids, keys and lengths of the documents, the bits, and
the bit offset of every ``CHECKPOINT``-th id. All stretches between such offsets are decoded side by side, one table lookup
for an id: the table has an entry for every possible run of ``MAX_LENGTH`` bits.

Rows
    A null or empty text has only the end id. Documents with equal keys follow each other ordered by a hash of their text; null
    keys come first. An empty table gives files without rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulight.llm.flat import distinct_spans, flat_text, pieces, slices, spans_hash, tidied, worker_memory
from tabulight.llm.pieces import spread
from tabulight.llm.storage import kept

BLOCK, CHECKPOINT, MAX_LENGTH = 1 << 16, 512, 20
BATCH_BYTES = 2 << 20
#: Stretches of text whose ids a Python worker remembers (some 60 bytes each), and the bytes of the longest of them.
REMEMBERED, LONGEST = 800_000, 64
PART_ROWS = 8_000
DECODE_BLOCKS = 64


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Length of each symbol's code, ``limit`` at most and the best under that limit (package-merge); 0 for a count of 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight, packages, leaf = counts[used].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        order = np.argsort(merged, kind="stable")
        leaf.append(order < len(weight))
        merged = merged[order]
        packages = merged[0: len(merged) - 1: 2] + merged[1::2]
    take = 2 * len(used) - 2
    for is_leaf in reversed(leaf):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with a code in the order of their codes (by length, then symbol), and each one's code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    space = np.int64(1) << (MAX_LENGTH - lengths[order])
    return order, (np.cumsum(space) - space) >> (MAX_LENGTH - lengths[order])


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids' codes, highest first, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids]
    end = np.cumsum(size)
    at = end - size
    value = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    total = (int(end[-1]) + 31) // 32 + 1 if len(ids) else 0
    word = at >> 5
    bits = np.bincount(word, (value >> np.uint64(32)).astype(float), total) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), total)
    return bits[:total].astype(">u4").tobytes(), at[::CHECKPOINT]


class Decoder:
    """The lookup table of a code: for every run of MAX_LENGTH bits the id that it starts with, and the length of its code."""

    def __init__(self, lengths: np.ndarray):
        order, _ = canonical(lengths)
        times = np.int64(1) << (MAX_LENGTH - lengths[order])
        self.ids, self.lengths = np.zeros(1 << MAX_LENGTH, np.int32), np.ones(1 << MAX_LENGTH, np.int64)
        self.ids[: times.sum()] = np.repeat(order, times)
        self.lengths[: times.sum()] = np.repeat(lengths[order], times)

    def unpack(self, blocks: list[bytes], counts: list[int], checkpoints: list[np.ndarray]) -> np.ndarray:
        """The ids of some blocks, one after the other."""
        starts = np.array([0, *accumulate(len(b) // 4 for b in blocks)], np.int64)
        words = np.append(np.frombuffer(b"".join(blocks), ">u4").astype(np.uint64), np.zeros(2, np.uint64))
        at = np.concatenate([c + 32 * s for c, s in zip(checkpoints, starts[:-1], strict=True)]) if blocks else np.zeros(0, np.int64)
        left = np.concatenate([np.minimum(CHECKPOINT, n - CHECKPOINT * np.arange(len(c))) for c, n in zip(checkpoints, counts, strict=True)]) if blocks else at
        out, first = np.empty(int(left.sum()), np.int32), np.cumsum(left) - left
        live = np.arange(len(at))
        for step in range(int(left.max(initial=0))):
            if step and step >= int(left[live].min()):
                live = live[left[live] > step]
            p = at[live]
            window = ((words[p >> 5] << np.uint64(32) | words[(p >> 5) + 1]) << (p & 31).astype(np.uint64)) >> np.uint64(64 - MAX_LENGTH)
            window = window.astype(np.int64)
            out[first[live] + step] = self.ids[window]
            at[live] = p + self.lengths[window]
        return out


LETTER_OR_DIGIT, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN[0x21:0x7F] = ~LETTER_OR_DIGIT[0x21:0x7F]
#: A space, if any, and letters: one word for the byte-level pattern, so the model can have it at once.
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF]|\xC9[\x80-\x8F])+")


def byte_signs() -> dict[int, str]:
    """The sign for each byte in byte-level vocabularies: printable ones stand for themselves, the rest for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def cuts_at_spaces(tokenizer) -> bool:
    """Whether it is a byte-level tokenizer that changes no text and has the usual pattern."""
    parts = json.loads(tokenizer.to_str())
    first = parts["pre_tokenizer"] or {}
    return parts["normalizer"] is None and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not any(
        set(t["content"]) & set(" \n") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])


def sure_signs(tokenizer) -> np.ndarray:
    """For each byte, whether it is a sign at which a word surely ends: one that no token found whole in texts has inside."""
    found = SIGN.copy()
    if not tokenizer.encode_special_tokens:
        found[[b for t in json.loads(tokenizer.to_str())["added_tokens"] for b in t["content"].encode()]] = False
    return found


def encode_all(tokenizer, texts: list[str], at_once: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """The ids of short texts, one after the other, and their numbers, a bounded number of texts at a time."""
    ids, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for first in range(0, len(texts), at_once):
        found = [e.ids for e in tokenizer.encode_batch_fast(texts[first: first + at_once], add_special_tokens=False)]
        size.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(size[-1].sum())))
    return np.concatenate(ids), np.concatenate(size)


def encode_words(tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for stretches of text: plain words go to the tokenizer's model, without its search for words."""
    signs = {byte: sign for byte, sign in byte_signs().items() if byte != 0x0A}
    plain = np.fromiter((LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
    spelled = b"\n".join(w for w, p in zip(words, plain, strict=True) if p).decode("latin-1").translate(signs).split("\n") if plain.any() else []
    model = tokenizer.model
    found = [model.tokenize(w) for w in spelled]
    rest, count = encode_all(tokenizer, [w.decode("utf-8", "replace") for w, p in zip(words, plain, strict=True) if not p])
    size = np.empty(len(words), np.int64)
    size[plain], size[~plain] = np.fromiter(map(len, found), np.int64, len(found)), count
    out, mine = np.empty(int(size.sum()), np.int32), np.repeat(plain, size)
    out[mine] = np.fromiter((t.id for w in found for t in w), np.int32, int(size[plain].sum()))
    out[~mine] = rest
    return out, size


class Known:
    """The ids of stretches of text seen before: a hash table in numpy arrays, whose entries are compared byte by byte.

    Stretches of more than LONGEST bytes are not kept. A full memory of REMEMBERED stretches is forgotten and begun anew.
    """

    def __init__(self):
        self.whole_texts: bool | None = None            # whether the tokenizer needs them
        self.signs = SIGN
        self.clear()

    def clear(self) -> None:
        self.count = self.used = self.spelled = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.hash, self.begin, self.length = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.bytes, self.flat = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int32)
        self.first, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of the entry with each hash, -1 if there is none."""
        place, live, mask = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), np.uint64(len(self.slots) - 1)
        slot = (hashes & mask).astype(np.int64)
        while len(live):
            at = self.slots[slot[live]]
            same = (at >= 0) & (self.hash[at] == hashes[live])
            place[live[same]] = at[same]
            live = live[(at >= 0) & ~same]
            slot[live] = slot[live] + 1 & int(mask)
        return place

    def enter(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """New entries into free slots; of those that want the same one, one gets it and the others go on."""
        live, mask = np.arange(len(hashes)), len(self.slots) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(live):
            free = live[self.slots[slot[live]] < 0]
            self.slots[slot[free]] = places[free]
            live = live[self.slots[slot[live]] != places[live]]
            slot[live] = slot[live] + 1 & mask

    def encode(self, found: pa.Array, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it each of the stretches (large_binary, all different) has its own, and how many.

        ``encode_new`` gives the ids of unknown stretches, one after the other, and their numbers.
        """
        if self.count > REMEMBERED:
            self.clear()
        data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
        edges = np.frombuffer(found.buffers()[1] or bytes(8), np.int64)[found.offset: found.offset + len(found) + 1]
        length = np.diff(edges)
        hashes = spans_hash(data, edges[:-1], edges[1:])
        place = self.find(hashes)
        there = np.flatnonzero(place >= 0)
        there = there[self.length[place[there]] == length[there]]
        differs = self.bytes[spread(self.begin[place[there]], length[there])] != data[spread(edges[there], length[there])]
        wrong = np.zeros(len(place), bool)
        wrong[np.repeat(there, length[there])[differs]] = True
        known = np.zeros(len(place), bool)
        known[there] = True
        known &= ~wrong
        unknown = np.flatnonzero(~known)
        short = length[unknown] <= LONGEST
        unknown, n = np.concatenate([unknown[short], unknown[~short]]), int(short.sum())     # those that are kept come first
        flat, size = encode_new(found.take(pa.array(unknown)).to_pylist())
        first = self.used + np.cumsum(size) - size
        self.flat = grown(self.flat, self.used, flat)
        out_first, out_size = self.first[place].astype(np.int64), self.size[place].astype(np.int64)
        out_first[unknown], out_size[unknown] = first, size
        kept_now, more = unknown[:n], np.arange(self.count, self.count + n)
        self.hash = grown(self.hash, self.count, hashes[kept_now])
        self.begin = grown(self.begin, self.count, self.spelled + np.cumsum(length[kept_now]) - length[kept_now])
        self.length = grown(self.length, self.count, length[kept_now])
        self.bytes = grown(self.bytes, self.spelled, data[spread(edges[kept_now], length[kept_now])])
        self.first, self.size = grown(self.first, self.count, first[:n]), grown(self.size, self.count, size[:n])
        self.count, self.used, self.spelled = self.count + n, self.used + int(size[:n].sum()), self.spelled + int(length[kept_now].sum())
        if 2 * self.count > len(self.slots):
            self.slots = np.full(4 << int(self.count).bit_length(), -1, np.int32)
            self.enter(self.hash[: self.count], np.arange(self.count))
        else:
            self.enter(hashes[kept_now], more)
        return self.flat, out_first, out_size


def grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` behind its first ``used`` values; its room doubles when it is full."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.empty(max(used, len(more)) + len(more), array.dtype)])
    array[used: used + len(more)] = more
    return array


def encode_texts(tokenizer, column: pa.Array, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the number of each text.

    A byte-level tokenizer cuts between a word and a single space or line feed that another word follows, and between a letter or digit
    and a sign, whatever stands further away. So each distinct stretch between such cuts is encoded once, and texts are put
    together from them. Other tokenizers get whole texts.
    """
    known = Known() if known is None else known
    if known.whole_texts is None:
        known.whole_texts, known.signs = not cuts_at_spaces(tokenizer), sure_signs(tokenizer)
    if known.whole_texts:
        return encode_all(tokenizer, [t or "" for t in column.to_pylist()], 64)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for data, offsets in pieces(*flat_text(column), BATCH_BYTES):
        n = np.zeros(len(offsets) - 1, np.int64)
        if len(data):
            plain = (data > 0x20) & (data != 0x7F)
            # A character of more bytes that might be white space is not a plain neighbour.
            odd = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
            before, after = plain & ~odd, plain & ~odd
            before[1:] &= ~((data[:-1] == 0xC2) & (data[1:] >= 0x80))
            before[2:] &= ~((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & (data[2:] >= 0x80))
            single = np.zeros(len(data), bool)
            single[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & before[:-2] & after[2:]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            single[edges] = single[edges - 1] = False
            opens = single.copy()
            opens[1:] |= single[:-1] & (data[:-1] == 0x0A)
            opens[1:] |= LETTER_OR_DIGIT[data[:-1]] & known.signs[data[1:]]
            opens[0] = True
            opens[edges] = True
            starts = np.flatnonzero(opens)
            found, which = distinct_spans(data, starts, np.append(starts[1:], len(data)))
            flat, begin, size = known.encode(found, lambda new: encode_words(tokenizer, new))
            total = np.concatenate([[0], np.cumsum(size[which])])
            first = np.searchsorted(starts, offsets)
            n = total[first[1:]] - total[first[:-1]]
            ids.append(flat[spread(begin[which], size[which])])
        counts.append(n)
    return np.concatenate(ids), np.concatenate(counts)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, text: str, key: str) -> DataFrame:
    """Blocks of ids, in order: ``part`` (ascending), ``offset`` of the first id in the part, keys and lengths of documents, ``ids`` (compressed)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = max(1, -(-docs.select(key).count() // PART_ROWS))
    ordered = rows.repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h").select("key", "text")
    kind = rows.schema["key"].dataType.simpleString()

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        loaded, part, offset = Tokenizer.from_file(tokenizer), TaskContext.get().partitionId(), 0
        key_type, known = None, worker_memory(("token_files", tokenizer), Known)
        held: list[tuple] = []
        for batch in batches:
            keys, done = batch.column("key"), 0
            key_type = keys.type
            for part_of in slices(batch.column("text"), BATCH_BYTES):
                ids, counts = encode_texts(loaded, part_of, known)
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32), counts + 1
                held.append((keys.slice(done, len(part_of)), counts, ids))
                done += len(part_of)
            if sum(len(i) for _, _, i in held) >= BLOCK:
                yield from cut(held, key_type, part, offset)
                offset += sum(len(i) for _, _, i in held)
                held = []
        if held:
            yield from cut(held, key_type, part, offset)

    def cut(held: list[tuple], key_type: pa.DataType, part: int, offset: int) -> Iterator[pa.RecordBatch]:
        keys = pa.chunked_array([k for k, _, _ in held], key_type).combine_chunks()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        counts, ids = np.concatenate([c for _, c, _ in held]), np.concatenate([i for _, _, i in held])
        ends = np.cumsum(counts)
        block = (ends - counts) // BLOCK
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(counts)), strict=True):
            first, last = int(ends[a] - counts[a]), int(ends[b - 1])
            own = np.array([0, b - a], np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([offset + first], pa.int64()), pa.ListArray.from_arrays(pa.array(own), keys.slice(a, b - a)),
                pa.ListArray.from_arrays(pa.array(own), pa.array(counts[a:b], pa.int64())), pa.array([last - first], pa.int64()),
                pa.array([pa.compress(ids[first:last].tobytes(), "zstd", asbytes=True)], pa.binary()),
            ], ["part", "offset", "keys", "sizes", "n_ids", "ids"])

    return ordered.mapInArrow(encode, f"part int, offset bigint, keys array<{kind}>, sizes array<bigint>, n_ids bigint, ids binary")


def loose(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, raw in zip(batch.column("n_ids").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(pa.decompress(raw.as_buffer(), 4 * n, "zstd"), np.int32)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, text: str = "text", key: str = "doc_id") -> None:
    """Encode all texts and write them to ``folder``; ``tokenizer`` is the path of its file on the executors.

    Texts are encoded once: their ids are kept (in the same partitions and order) while all of them are counted, then coded.
    The driver gets one count for each id of the vocabulary, and one total for each partition.
    """
    spark = docs.sparkSession
    blocks = kept(tokenized(docs, tokenizer, end_id, text, key))

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in loose(batch):
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counted = blocks.select("n_ids", "ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n")).collect()
    counts = np.zeros(max((r[0] for r in counted), default=-1) + 1, np.int64)
    for i, n in counted:
        counts[i] = n
    lengths = code_lengths(counts)
    order, code = canonical(lengths)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = code
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    base = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    kind = blocks.schema["keys"].dataType.simpleString()

    @tidied
    def code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [pack(ids, codes, lengths) for ids in loose(batch)]
            first = [base[p] + o for p, o in zip(batch.column("part").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(first, pa.int64()), batch.column("n_ids"), batch.column("keys"), batch.column("sizes"),
                pa.array([at for _, at in coded], pa.list_(pa.int64())), pa.array([bits for bits, _ in coded], pa.binary()),
            ], ["first_id", "n_ids", "keys", "sizes", "checkpoints", "bits"])

    coded = blocks.mapInArrow(code_blocks, f"first_id bigint, n_ids bigint, keys {kind}, sizes array<bigint>, checkpoints array<bigint>, bits binary")
    coded.write.parquet(f"{folder}/blocks")
    table = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(table, "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """One row per document: its key, ``start`` (ids of all documents before it) and ``ids`` (array<int>)."""
    table = spark.read.parquet(f"{folder}/codes").collect()                     # at most the vocabulary
    lengths = np.zeros(max((r[0] for r in table), default=0) + 1, np.int64)
    for i, n in table:
        lengths[i] = n
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    @tidied
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for whole in batches:
            for done in range(0, whole.num_rows, DECODE_BLOCKS):
                batch = whole.slice(done, DECODE_BLOCKS)
                checkpoints = [np.asarray(c.values) for c in batch.column("checkpoints")]
                ids = decoder.unpack([b.as_py() for b in batch.column("bits")], batch.column("n_ids").to_pylist(), checkpoints)
                sizes = pc.list_flatten(batch.column("sizes")).to_numpy()
                ends = np.cumsum(sizes)
                docs = pc.list_value_length(batch.column("sizes")).to_numpy()
                block_ids = batch.column("n_ids").to_numpy()
                start = np.repeat(batch.column("first_id").to_numpy() - (np.cumsum(block_ids) - block_ids), docs) + ends - sizes
                yield pa.RecordBatch.from_arrays([
                    pc.list_flatten(batch.column("keys")), pa.array(start),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))], [key, "start", "ids"])

    return blocks.mapInArrow(decode, f"`{key}` {kind}, start bigint, ids array<int>")
