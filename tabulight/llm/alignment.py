"""How the tokens of two tokenizers lie on each other, text by text, and which pairs of ids belong together in the whole corpus.

Both token sequences of a text cover the same bytes. Where a token of each ends at the same byte is a cut. Cuts are found by dividing: an
interval of tokens looks for a common end near its middle, by bisection of the other side's ends, and further and further away from the
middle; at the cut it falls into two intervals, which go on. An interval without a common end inside is a group.
All intervals of a few megabytes of texts take each step side by side, in numpy.

Each pair of tokens that share a byte is a link. Parts of about ``PART`` bytes of texts keep their links as places in a list of the part's
different id pairs. The lists are counted over the corpus by a shuffle of (pair, count), and the counts that a part needs come back to
it by its pairs. Only one row for each id of the second vocabulary is broadcast.

Rows
    A null or empty text, or one that either tokenizer does not keep byte by byte, has no tokens: zeros, and an empty string of groups.
    Repeated rows and equal or null keys give a row each. A very long text is a part of its own. An empty table gives an empty
    result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabulight.llm.flat import flat_text, slices, tidied, worker_memory
from tabulight.llm.pieces import MARK, MergeTable, encode_batch, spread
from tabulight.llm.storage import kept
from tabulight.llm.token_files import Known, byte_signs, encode_texts

#: Bytes of text aligned at once; bytes of text of a part.
BATCH_BYTES, PART = 2 << 20, 8 << 20


class Spelling:
    """The bytes of each token of a vocabulary."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.first[ids], self.size[ids])]


def byte_level_spelling(tokenizer) -> Spelling:
    """Of a byte-level vocabulary; an added token that is no such spelling stands for its own bytes."""
    back = {sign: byte for byte, sign in byte_signs().items()}
    words = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return Spelling([bytes(back[c] for c in w) if all(c in back for c in w) else w.encode() for w in words])


def piece_spelling(model) -> Spelling:
    """Of a SentencePiece vocabulary: the space mark is a space, pieces of one byte are that byte."""
    return Spelling([bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.get_piece_size())])


def kept_bytes(data: np.ndarray, offsets: np.ndarray, spelling: Spelling, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each text is what its tokens spell."""
    total = np.concatenate([[0], np.cumsum(spelling.size[ids])])
    ends = total[np.cumsum(counts)]
    size = np.diff(np.append(0, ends))
    same = size == np.diff(offsets)
    got, text = spelling.joined(ids), np.repeat(same, np.diff(offsets))
    differs = got[np.repeat(same, size)] != data[text]
    if differs.any():
        owner = np.repeat(np.flatnonzero(same), size[same])
        same[np.unique(owner[differs])] = False
    return same


def groups(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first token of every group on both sides, in order. Texts start at tokens ``first_a`` and ``first_b`` (one more than texts).

    ``ends_a``, ``ends_b``: the byte at which each token ends, ascending over all texts, which both sides cover.
    """
    low_a, high_a, low_b, high_b = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    found_a, found_b = [], []
    while len(low_a):
        whole = (high_a - low_a == 1) | (high_b - low_b == 1)       # one token on a side: no end inside
        cut_a, cut_b = near_middle(ends_a, ends_b, low_a, high_a, ~whole)
        leaf = cut_a < 0
        found_a.append(low_a[leaf])
        found_b.append(low_b[leaf])
        low_a, high_a, low_b, high_b, cut_a, cut_b = (x[~leaf] for x in (low_a, high_a, low_b, high_b, cut_a, cut_b))
        low_a, high_a = np.concatenate([low_a, cut_a]), np.concatenate([cut_a, high_a])
        low_b, high_b = np.concatenate([low_b, cut_b]), np.concatenate([cut_b, high_b])
    a, b = (np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    return a, b


def near_middle(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of tokens the tokens after the common end next to its middle, -1 without one inside.

    First the middle itself is looked up among the other side's ends, then its neighbours, twice as many in each round.
    """
    cut_a, cut_b = np.full(len(low), -1), np.full(len(low), -1)
    middle, last = (low + high - 2) // 2, high - 2                  # ends from low to last lie inside
    open_, near, far = np.flatnonzero(wanted), 0, 1
    while len(open_):
        m = middle[open_]
        left = np.maximum(low[open_], m - far + 1)
        n_left = np.maximum(0, m - max(near, 0) - left + 1)
        right = m + max(near, 1)
        n_right = np.maximum(0, np.minimum(last[open_], m + far - 1) - right + 1)
        there = n_left + n_right > 0
        open_, m, left, n_left, right, n_right = (x[there] for x in (open_, m, left, n_left, right, n_right))
        probe = np.concatenate([spread(left, n_left), spread(right, n_right)])
        owner = np.concatenate([np.repeat(np.arange(len(open_)), n) for n in (n_left, n_right)])
        place = np.searchsorted(ends_b, ends_a[probe])
        hit = ends_b[place] == ends_a[probe]
        probe, owner, place = probe[hit], owner[hit], place[hit]
        order = np.lexsort((probe, np.abs(probe - m[owner]), owner))
        probe, owner, place = probe[order], owner[order], place[order]
        first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
        done = owner[first]
        cut_a[open_[done]], cut_b[open_[done]] = probe[first] + 1, place[first] + 1
        rest = np.ones(len(open_), bool)
        rest[done] = False
        open_, near, far = open_[rest], far, far * 2
    return cut_a, cut_b


def group_strings(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, first_group: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; ``first_group``: each text's first group (one more than texts)."""
    n_a, n_b = np.diff(np.append(group_a, len(ids_a))), np.diff(np.append(group_b, len(ids_b)))
    start = np.cumsum(n_a + n_b) - (n_a + n_b)                      # place of each group among the tokens of both sides
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[spread(start, n_a)], ids[spread(start + n_a, n_b)] = ids_a, ids_b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[start + n_a - 1], mark[start + n_a + n_b - 1] = ord("|"), ord(";")
    signs = np.zeros((len(ids), 8), np.uint8)                       # up to seven digits, then the mark; zeros are left out
    rest = ids.copy()
    for digit in range(6, -1, -1):
        signs[:, digit] = np.where((rest > 0) | (digit == 6), rest % 10 + 0x30, 0)
        rest //= 10
    signs[:, 7] = mark
    used = signs.reshape(-1) != 0
    raw = signs.reshape(-1)[used].tobytes()
    ends = np.cumsum(used.reshape(-1, 8).sum(axis=1))
    ends = np.append(0, ends)[np.append(start, len(ids))[first_group]].tolist()
    return [hashlib.sha256(raw[a: b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Aligner:
    """Both tokenizers, what they remember, and the alignment of batches of texts."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(byte_level)
        self.tokenizer.encode_special_tokens = True                 # their strings in texts are plain text
        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.table, self.known = MergeTable(model), (Known(), Known())
        self.spelling = byte_level_spelling(self.tokenizer), piece_spelling(model)
        self.base = model.get_piece_size()

    def align(self, texts: pa.Array) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray]:
        """Columns with a value for each text; the pair (a x base + b) of every link; each text's first link (one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), none, space), texts, none)
        ids_a, n_a = encode_texts(self.tokenizer, spaced, self.known[0])
        found = encode_batch(self.table, texts, None, self.known[1])
        ids_b, n_b = np.asarray(found.values), np.diff(np.asarray(found.offsets)).astype(np.int64)
        data, offsets = flat_text(spaced)
        good = np.diff(offsets) > 0
        for spelling, ids, n in zip(self.spelling, (ids_a, ids_b), (n_a, n_b), strict=True):
            good &= kept_bytes(data, offsets, spelling, ids, n)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)].astype(np.int64), ids_b[np.repeat(good, n_b)].astype(np.int64)
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        ends_a, ends_b = np.cumsum(self.spelling[0].size[ids_a]), np.cumsum(self.spelling[1].size[ids_b])
        some = np.append(np.flatnonzero(good), len(good))
        group_a, group_b = groups(ends_a, ends_b, first_a[some], first_b[some])
        first_group = np.searchsorted(group_a, first_a)
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends     # each stretch between two ends is one link
        place_a, place_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        first_link = np.searchsorted(place_a, first_a)
        columns = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(first_group), "n_links": np.diff(first_link),
                   "groups_sha256": group_strings(ids_a, ids_b, group_a, group_b, first_group)}
        return columns, ids_a[place_a] * self.base + ids_b[place_b], first_link


COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_parts(docs: DataFrame, byte_level: str, pieces: str, part_bytes: int) -> DataFrame:
    """One row per part: keys and numbers of its texts, its different pairs and how often each occurs, and the place of each link among the pairs."""
    key = docs.schema["key"].dataType.simpleString()
    kinds = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]

    @tidied
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, task, seq = worker_memory(("alignment", byte_level, pieces), lambda: Aligner(byte_level, pieces)), TaskContext.get().partitionId(), 0
        keys, columns, links, size = [], [], [], 0
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def packed() -> pa.RecordBatch:
            all_keys = pa.chunked_array(keys).combine_chunks()
            all_keys = all_keys.combine_chunks() if isinstance(all_keys, pa.ChunkedArray) else all_keys
            pair = np.concatenate(links)
            order = np.argsort(pair, kind="stable")
            new = np.append(True, pair[order][1:] != pair[order][:-1]) if len(pair) else np.zeros(0, bool)
            place = np.empty(len(pair), np.int32)
            place[order] = np.cumsum(new) - 1
            edges = np.flatnonzero(new)
            values = [pa.array(np.concatenate([c[name] for c in columns]) if kind != pa.string() else [x for c in columns for x in c[name]], kind) for name, kind in kinds]
            return pa.RecordBatch.from_arrays([
                pa.array([task << 32 | seq], pa.int64()), one(all_keys), *(one(v) for v in values), one(pa.array(pair[order][edges])),
                one(pa.array(np.diff(np.append(edges, len(pair))))), pa.array([pa.compress(np.ascontiguousarray(place).tobytes(), "zstd", asbytes=True)], pa.binary()),
            ], ["part", "key", *(name for name, _ in kinds), "pairs", "counts", "links"])

        for batch in batches:
            done = 0
            for texts in slices(batch.column("text"), BATCH_BYTES):
                found, pair, _ = aligner.align(texts)
                keys.append(batch.column("key").slice(done, len(texts)))
                columns.append(found)
                links.append(pair)
                done += len(texts)
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= part_bytes:
                    yield packed()
                    seq, keys, columns, links, size = seq + 1, [], [], [], 0
        if keys:
            yield packed()

    longs = ", ".join(f"{c} array<bigint>" for c in COLUMNS)
    return docs.mapInArrow(align, f"part bigint, key array<{key}>, {longs}, groups_sha256 array<string>, pairs array<bigint>, counts array<bigint>, links binary")


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", key: str = "doc_id", part_bytes: int = PART) -> DataFrame:
    """One row per text: its key, tokens of both sides, groups, links, links whose pair is the commonest of its second id, counts of all its links' pairs, digest of its groups.

    ``byte_level`` and ``pieces`` are paths of the tokenizers' files on the executors; the first gets a space before each text, which the second adds by itself.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = kept(aligned_parts(rows, byte_level, pieces, part_bytes))
    base = piece_count(pieces)
    listed = parts.select("part", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("part", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = kept(listed.groupBy("pair").agg(F.sum("n").alias("total")))
    most = total.groupBy((F.col("pair") % base).alias("b")).agg(F.max("total").alias("most"))       # at most one row for each id
    known = total.withColumn("b", F.col("pair") % base).join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    counted = listed.select(F.col("part").alias("of_part"), "place", "pair").join(known, "pair").select("of_part", "place", "total", "best")
    kind = rows.schema["key"].dataType.simpleString()

    def score(own: pa.Table, counts: pa.Table) -> pa.Table:
        n_pairs = counts.num_rows
        total, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, bool)
        place = counts.column("place").to_numpy()
        total[place], best[place] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
        flat = {c: pc.list_flatten(own.column(c)).combine_chunks() for c in ("key", *COLUMNS, "groups_sha256")}
        n = flat["n_links"].to_numpy()
        raw = own.column("links")[0].as_buffer()
        links = np.frombuffer(pa.decompress(raw, 4 * int(n.sum()), "zstd"), np.int32) if n.sum() else np.zeros(0, np.int32)
        edges = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[0], np.cumsum(v[links].astype(np.int64))]) for v in (best, total)]
        n_best, count_sum = (s[edges[1:]] - s[edges[:-1]] for s in sums)
        return pa.table({"key": flat["key"], **{c: flat[c] for c in COLUMNS}, "n_best": n_best, "count_sum": count_sum, "groups_sha256": flat["groups_sha256"]})

    slim = parts.select("part", "key", *COLUMNS, "groups_sha256", "links")
    schema = f"key {kind}, {', '.join(f'{c} bigint' for c in COLUMNS)}, n_best bigint, count_sum bigint, groups_sha256 string"
    return slim.groupBy("part").cogroup(counted.groupBy("of_part")).applyInArrow(score, schema).withColumnRenamed("key", key)


def piece_count(pieces: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
