"""SentencePiece encoding by vectorised merge rounds, and decoding.

A BPE model joins, again and again, the pair of neighbouring symbols with the best rank, leftmost first. No piece has a
space mark after another character, so the words (a run of spaces with what follows it) do not influence each other: all
distinct words of a batch are merged at once. Their symbols lie in one flat array; every round finds each word's best
rank, merges its leftmost pairs and compacts the array, until no word has a pair left.

Rows
    A null or empty text has no ids but the end id. Every text is encoded whole. Repeated rows give repeated results, an
    empty table an empty one. Other columns stay; a column with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from tabulight.llm.flat import distinct_spans, flat_text, pieces, slices, tidied

MARK = "▁"
#: No pair of these two symbols can be merged.
NEVER = np.iinfo(np.int32).max
#: Longer words (a word of the text is rarely longer) are merged one pair at a time with a heap: the same result, and no
#: round over a long word for each of its merges.
LONG_WORD = 512
#: Texts whose words are merged together. A task's memory is some fifty times this.
BATCH_BYTES, SLICE_BYTES = 2 << 20, 1 << 19


class MergeTable:
    """What merging needs of a model: the symbol of each character, and rank and result of each pair."""

    def __init__(self, model):
        size = model.get_piece_size()
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        ids = [i for i in range(size) if not special(i)]
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        self.pieces = {model.id_to_piece(i): i for i in ids}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece of the model crosses a word's start")
        self.first_byte = next((i for i in range(size) if model.is_byte(i)), None)
        if self.first_byte is None or not all(model.is_byte(self.first_byte + b) for b in range(256)):
            raise ValueError("the model has no pieces for single bytes")
        self.size = size
        symbol, score = dict(self.pieces), {i: model.get_score(i) for i in ids}
        for c in sorted({c for p in self.pieces for c in p} - set(symbol)):
            symbol[c] = size + len(symbol) - len(self.pieces)       # a character that only longer pieces have
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.chars = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.base = np.int64(size + len(symbol) + 1)
        found = {}
        for p, i in self.pieces.items():
            for cut in range(1, len(p)):
                if p[:cut] in symbol and p[cut:] in symbol:
                    found[symbol[p[:cut]] * int(self.base) + symbol[p[cut:]]] = (order[score[i]], i)
        keys = sorted(found)
        self.keys = np.array(keys, np.int64)
        self.ranks = np.array([found[k][0] for k in keys], np.int32)
        self.results = np.array([found[k][1] for k in keys], np.int32)
        #: Pairs of ASCII characters that some piece has; no merge joins any other two. A space stands for the mark.
        self.joined = np.zeros((128, 128), bool)
        for a, b in {(a, b) for p in self.pieces for a, b in pairwise(p.replace(MARK, " ")) if a < "\x80" and b < "\x80"}:
            self.joined[ord(a), ord(b)] = True
        #: For most pairs there is no piece: one bit of a hashed key already says so.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair, NEVER where there is none."""
        rank, result = np.full(len(left), NEVER, np.int32), np.full(len(left), -1, np.int32)
        keys = left.astype(np.int64) * self.base + right
        maybe = np.flatnonzero((left >= 0) & (right >= 0))
        maybe = maybe[self.bits[self._slot(keys[maybe])]]
        wanted = keys[maybe]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        good = self.keys[place] == wanted
        rank[maybe[good]], result[maybe[good]] = self.ranks[place[good]], self.results[place[good]]
        return rank, result


def one_by_one(table: MergeTable, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same merges for one long word, with a heap: symbols left over and where each begins."""
    n, symbol = len(symbols), symbols.tolist()
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank, result = table.look_up(symbols[:-1], symbols[1:])
    heap = [(int(rank[i]), i, symbol[i], symbol[i + 1], int(result[i])) for i in np.flatnonzero(rank != NEVER).tolist()]
    heapify(heap)
    while heap:
        _, i, a, b, joined = heappop(heap)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue
        symbol[i], symbol[j], after[i] = joined, -2, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        near = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y >= 0]
        if near:
            rank, result = table.look_up(np.array([symbol[x] for x, _ in near], np.int32), np.array([symbol[y] for _, y in near], np.int32))
            for (x, y), r, m in zip(near, rank.tolist(), result.tolist(), strict=True):
                if r != NEVER:
                    heappush(heap, (r, x, symbol[x], symbol[y], m))
    left = np.array(symbol, np.int32)
    at = np.flatnonzero(left != -2)
    return left[at], at


def merge_rounds(table: MergeTable, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left when no pair can be merged, in order, and where each begins. ``first``: each word's first symbol."""
    length = np.diff(np.append(first, len(symbols)))
    word = np.repeat(np.arange(len(first)), length)
    done_symbols, done_at = [], []
    long = length > LONG_WORD
    for w in np.flatnonzero(long):
        s, at = one_by_one(table, symbols[first[w]: first[w] + length[w]])
        done_symbols.append(s)
        done_at.append(at + first[w])
    at = np.flatnonzero(~long[word])
    sym, word = symbols[at], word[at]

    def pair_ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, i + 1), within words."""
        rank, result = np.full(len(i), NEVER, np.int32), np.full(len(i), -1, np.int32)
        inner = np.flatnonzero(i + 1 < len(sym))
        inner = inner[word[i[inner]] == word[i[inner] + 1]]
        rank[inner], result[inner] = table.look_up(sym[i[inner]], sym[i[inner] + 1])
        return rank, result

    rank, result = pair_ranks(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(starts, len(sym)))
        best = np.minimum.reduceat(rank, starts)
        live = np.repeat(best != NEVER, size)
        if not live.all():                                          # words without a pair leave the array
            done_symbols.append(sym[~live])
            done_at.append(at[~live])
            sym, word, at, rank, result = sym[live], word[live], at[live], rank[live], result[live]
            size, best = size[best != NEVER], best[best != NEVER]
            if not len(sym):
                break
        hit = rank == np.repeat(best, size)
        where = np.flatnonzero(hit)
        head = np.append(True, where[1:] != where[:-1] + 1)         # pairs that overlap the one before them wait
        run = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - run) % 2 == 0]
        own = word[where]
        opens = np.append(True, own[1:] != own[:-1])
        if not opens.all():                                         # words with several pairs of their best rank
            many = np.flatnonzero(~opens | np.append(~opens[1:], False))
            i = where[many]
            joined = result[i]
            near = np.append(False, i[1:] == i[:-1] + 2)
            inner = (i > 0) & (word[np.maximum(i - 1, 0)] == word[i])
            left = np.where(near & inner, np.append(-1, joined[:-1]), np.where(inner, sym[np.maximum(i - 1, 0)], -1))
            nxt = np.minimum(i + 2, len(sym) - 1)
            right = np.where((i + 2 < len(sym)) & (word[nxt] == word[i]), sym[nxt], -1)
            better = np.minimum(table.look_up(left.astype(np.int32), joined)[0], table.look_up(joined, right.astype(np.int32))[0]) <= rank[i]
            if better.any():                                        # a merge that makes a better pair comes last in its round
                stop = np.zeros(len(where), np.int64)
                stop[many] = better
                ahead = np.cumsum(stop) - stop
                where = where[ahead == np.maximum.accumulate(np.where(opens, ahead, 0))]
        sym[where] = result[where]
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, at, rank, result = sym[keep], word[keep], at[keep], rank[keep], result[keep]
        changed = place[where]
        touched = np.zeros(len(sym), bool)
        touched[changed] = True
        touched[changed[changed > 0] - 1] = True
        changed = np.flatnonzero(touched)
        rank[changed], result[changed] = pair_ranks(changed)
    if not done_at:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    at = np.concatenate(done_at)
    order = np.argsort(at, kind="stable")
    return np.concatenate(done_symbols)[order], at[order]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first[0] ... first[0] + count[0] - 1, first[1] ... and so on."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def encode_words(table: MergeTable, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, one after the other, and their number. Words are bytes with spaces for the marks."""
    if not len(found):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    _, offsets, data = found.buffers()
    offsets = np.frombuffer(offsets, np.int64)[found.offset: found.offset + len(found) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]]
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first = leads[offsets[:-1] - offsets[0]]
    chars = np.where(chars == 0x20, ord(MARK), chars)
    symbols, at = merge_rounds(table, table.chars[chars], first)
    owner = np.searchsorted(first, at, "right") - 1
    strange = np.flatnonzero((symbols < 0) | (symbols >= table.size))        # characters without a piece become bytes
    count = np.ones(len(symbols), np.int64)
    spelled = [[table.first_byte + b for b in chr(c).encode()] for c in chars[at[strange]].tolist()]
    count[strange] = [len(s) for s in spelled]
    ids = np.repeat(symbols, count)
    if len(strange):
        begin = (np.cumsum(count) - count)[strange]
        ids[spread(begin, count[strange])] = np.concatenate(spelled)
    return ids.astype(np.int32), np.bincount(owner, count, len(found)).astype(np.int64)


def encode_batch(table: MergeTable, column: pa.Array, end: int | None, known=None) -> pa.Array:
    """The ids of each text. ``known``: a memory of words, for callers that encode many batches (``token_files.Known``)."""
    text = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
    none, mark = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    text = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(text), 0), none, mark), text, none)
    all_ids, all_counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for data, offsets in pieces(*flat_text(text), BATCH_BYTES):
        counts = np.zeros(len(offsets) - 1, np.int64)
        if len(data):
            space = data == 0x20
            opens = np.append(True, space[1:] & ~space[:-1])
            ascii_pair = (data[:-1] < 0x80) & (data[1:] < 0x80)
            opens[1:] |= ascii_pair & ~table.joined[data[:-1] & 0x7F, data[1:] & 0x7F]
            opens[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(opens)
            found, which = distinct_spans(data, starts, np.append(starts[1:], len(data)))
            if known is None:
                ids, size = encode_words(table, found)
                begin = np.cumsum(size) - size
            else:
                ids, begin, size = known.encode(found, lambda new: encode_words(table, pa.array(new, pa.large_binary())))
            word_of_text = np.searchsorted(starts, offsets)
            total = np.concatenate([[0], np.cumsum(size[which])])
            counts = total[word_of_text[1:]] - total[word_of_text[:-1]]
            all_ids.append(ids[spread(begin[which], size[which])])
        all_counts.append(counts)
    ids, counts = np.concatenate(all_ids), np.concatenate(all_counts)
    if end is not None:
        ids = np.insert(ids, np.cumsum(counts), end).astype(np.int32)
        counts = counts + 1
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def encode(text: Column, model: str, add_end: bool = True) -> Column:
    """The ids (array<int>) of a text, as the library gives them for this BPE model without sampling.

    ``model``: path of the model file on the executors. ``add_end``: the model's end id follows the last piece.
    """
    @F.arrow_udf("array<int>")
    @tidied
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        table = MergeTable(loaded)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield encode_batch(table, part, loaded.eos_id() if add_end else None)

    return ids(text)


def decoded(model, ids: pa.Array) -> pa.Array:
    offsets, values, valid = np.asarray(ids.offsets), np.asarray(ids.values), ids.is_valid().to_pylist()
    return pa.array([model.decode(values[a:b].tolist()) if v else None for a, b, v in zip(offsets[:-1], offsets[1:], valid, strict=True)], pa.string())


def encode_and_decode(text: Column, model: str, add_end: bool = True) -> Column:
    """struct<ids, text>: the ids of a text as ``encode`` gives them, and what the library decodes from them, in one pass."""
    @F.arrow_udf("struct<ids: array<int>, text: string>")
    @tidied
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        table = MergeTable(loaded)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                ids = encode_batch(table, part, loaded.eos_id() if add_end else None)
                yield pa.StructArray.from_arrays([ids, decoded(loaded, ids)], ["ids", "text"])

    return both(text)


def decode(ids: Column, model: str) -> Column:
    """The text that the library decodes from ids; null ids give null."""
    @F.arrow_udf("string")
    @tidied
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for first in range(0, len(batch), 500):
                yield decoded(loaded, batch.slice(first, 500))

    return text(ids)
