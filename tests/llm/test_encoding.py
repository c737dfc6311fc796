"""Token files (1) and SentencePiece (5), against their libraries."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulight.llm import pieces, queries, token_files
from tabulight.llm.storage import new_folder

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "th", "the", "▁", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "ß", "à", " à", "中", "😀", "aaaa", "ing", "x", "0", "<0x41>", "<|endoftext|>", "'s",
         " " * 17, " ", "　", " ", "\x85", "\x1c", "ab" * 9, "!!", "—"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)] + [" " * k for k in range(40)] + ["a" * k for k in range(40)]


def test_stretches_give_the_ids_of_whole_texts():
    tokenizer, texts = Tokenizer.from_file(BYTE_BPE), odd_texts(3000, 1)
    ids, counts = token_files.encode_texts(tokenizer, pa.array(texts))
    whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(i) for i in whole] and ids.tolist() == [i for w in whole for i in w]


@pytest.mark.parametrize("remembered", [0, 50, 10**6])
def test_remembered_stretches(remembered, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    tokenizer, known = Tokenizer.from_file(BYTE_BPE), token_files.Known()
    for seed in (5, 6, 7):
        texts = odd_texts(300, seed)
        ids, _ = token_files.encode_texts(tokenizer, pa.array(texts), known)
        assert ids.tolist() == [i for e in tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]
        assert known.count <= remembered + 6_000               # a full memory is begun anew before the next batch


def test_strings_of_special_tokens_as_plain_text():
    tokenizer, texts = Tokenizer.from_file(BYTE_BPE), ["a<|endoftext|>b", "x|endoftext", *odd_texts(500, 9)]
    tokenizer.encode_special_tokens = True
    ids, _ = token_files.encode_texts(tokenizer, pa.array(texts))
    assert ids.tolist() == [i for e in tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids] and 50256 not in ids


def test_remembered_words_are_the_library():
    model, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), odd_texts(900, 8)
    table, known = pieces.MergeTable(model), token_files.Known()
    for first in range(0, len(texts), 300):
        own = texts[first: first + 300]
        assert pieces.encode_batch(table, pa.array(own), None, known).to_pylist() == model.encode(own)


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost


@pytest.mark.parametrize("limit", [6, 8, 12, 20])
def test_code_lengths_are_the_best_within_the_limit(limit):
    counts = np.random.default_rng(limit).geometric(0.02, 40) * (np.arange(40) % 7 > 0)
    lengths = token_files.code_lengths(counts, limit)
    used = lengths[counts > 0]
    assert used.max() <= limit and (lengths[counts == 0] == 0).all() and np.isclose((0.5 ** used).sum(), 1)
    assert (lengths * counts).sum() >= huffman_cost(counts)
    if limit == 20:
        assert (lengths * counts).sum() == huffman_cost(counts)


def test_code_lengths_with_steep_counts():
    counts = np.array([1 << k for k in range(30)])
    lengths = token_files.code_lengths(counts, 6)
    assert lengths.max() == 6 and (0.5 ** lengths).sum() <= 1 and token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(5, int), 2)


def test_blocks_decode_from_their_checkpoints():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n).clip(max=999) for n in (1, 511, 512, 513, 5000)]
    lengths = token_files.code_lengths(np.bincount(np.concatenate(blocks)))
    order, code = token_files.canonical(lengths)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = code
    packed = [token_files.pack(b, codes, lengths) for b in blocks]
    back = token_files.Decoder(lengths).unpack([b for b, _ in packed], [len(b) for b in blocks], [c for _, c in packed])
    assert back.tolist() == np.concatenate(blocks).tolist()


def plain_token_rows(rows):
    tokenizer, start, out = Tokenizer.from_file(BYTE_BPE), 0, []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_documents(spark, docs):
    got = [tuple(r) for r in queries.op1_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    assert got == plain_token_rows(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_token_files_of_odd_rows(spark, odd, nothing):
    folder = new_folder(spark, "test")
    token_files.write(odd, folder, BYTE_BPE, 2)
    back = token_files.read(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    keys = [r.doc_id for r in back]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(back) == odd.count()
    assert [r.start for r in back] == np.cumsum([0] + [len(r.ids) for r in back])[:-1].tolist()
    expected = sorted((str(r.doc_id), tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in odd.collect())
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in back) == expected
    folder = new_folder(spark, "test")
    token_files.write(nothing, folder, BYTE_BPE, 2)
    assert token_files.read(spark, folder).count() == 0


def test_blocks_hold_whole_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    folder = new_folder(spark, "test")
    token_files.write(docs, folder, BYTE_BPE, None)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 100
    ids = token_files.read(spark, folder).orderBy("doc_id").select("ids").collect()
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert [r.ids for r in ids] == [e.ids for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("long_word", [4, 512])
def test_merge_rounds_are_the_library(long_word, monkeypatch):
    monkeypatch.setattr(pieces, "LONG_WORD", long_word)
    model, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), [*odd_texts(1500, 2), " " * 3000, "ab" * 3000, None]
    got = pieces.encode_batch(pieces.MergeTable(model), pa.array(texts), 2).to_pylist()
    assert got == model.encode([t or "" for t in texts], add_eos=True)


def test_sentencepiece_column(spark, odd, nothing, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for table in (odd, docs, nothing):
        rows = table.withColumn("ids", pieces.encode(F.col("text"), PIECES)).withColumn("back", pieces.decode(F.col("ids"), PIECES)).collect()
        for r in rows:
            expected = model.encode(r.text or "", add_eos=True)
            assert r.ids == expected and r.back == model.decode(expected)
        both = table.select(pieces.encode_and_decode(F.col("text"), PIECES).alias("x")).collect()
        assert sorted((r.x.ids, r.x.text) for r in both) == sorted((r.ids, r.back) for r in rows)
    assert spark.range(1).select(pieces.decode(F.lit(None).cast("array<int>"), PIECES)).first()[0] is None


def test_other_tokenizers_get_whole_texts():
    tokenizer, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), odd_texts(200, 4)
    assert not token_files.cuts_at_spaces(tokenizer) and token_files.cuts_at_spaces(Tokenizer.from_file(BYTE_BPE))
    ids, counts = token_files.encode_texts(tokenizer, pa.array([*texts, None]))
    whole = [e.ids for e in tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
    assert counts.tolist() == [len(i) for i in whole] and ids.tolist() == [i for w in whole for i in w]
