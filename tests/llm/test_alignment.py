"""Cross-tokenizer alignment (13) against a plain version with the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabulight.llm import alignment, queries
from tabulight.llm.token_files import byte_signs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain_tokens(tokenizer, model, text):
    """(id, end) of both sides, or nothing for texts that a side does not keep."""
    if not text:
        return [], []
    back = {s: b for b, s in byte_signs().items()}
    ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(back[c] for c in tokenizer.id_to_token(i))) for i in ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (a, b)):
        return [], []
    sides = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        sides.append(out)
    return sides


def plain_alignment(rows):
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    found, count = [], Counter()
    for key, text in rows:
        a, b = plain_tokens(tokenizer, model, text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, links, start = [], [], 0
        for cut in cuts:
            own = [[t for t in side if start <= t[1] and t[2] <= cut] for side in (a, b)] if len(a) < 300 else None
            groups.append((start, cut, own))
            start = cut
        j = 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        count.update(links)
        at, parts = [0, 0], []
        for _, cut, own in groups:
            sides = []
            for side, t in enumerate((a, b)):
                first = at[side]
                while at[side] < len(t) and t[at[side]][2] <= cut:
                    at[side] += 1
                sides.append([str(x[0]) for x in t[first: at[side]]])
            assert own is None or sides == [[str(x[0]) for x in o] for o in own]
            parts.append(",".join(sides[0]) + "|" + ",".join(sides[1]))
        found.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(key, n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha) for key, n_a, n_b, n_groups, links, sha in found]


def test_alignment_of_documents(spark, docs):
    got = sorted(tuple(r) for r in queries.op13_token_alignment(spark, SF).collect())
    assert got == sorted(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("part_bytes", [1, 1000, 8 << 20])
def test_alignment_of_odd_rows(spark, odd, part_bytes):
    odder = odd.unionByName(spark.createDataFrame([(20, "a▁b"), (21, "<|endoftext|> </s> <s> <0x41>"), (22, "  x  "), (23, "中文字 漢字😀😀"), (24, "\n\n"), (25, "1" * 400)], "doc_id bigint, text string"), True)
    got = sorted((tuple(r) for r in alignment.align(odder, A, B, part_bytes=part_bytes).collect()), key=repr)
    assert got == sorted(plain_alignment([(r.doc_id, r.text) for r in odder.select("doc_id", "text").collect()]), key=repr)
    zero = [r for r in got if r[0] in (4, 6, 20)]
    assert len(zero) == 3 and all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in zero)


def test_alignment_of_nothing_and_other_keys(spark, nothing):
    assert alignment.align(nothing, A, B).count() == 0
    for kind in ("int", "string"):
        table = spark.createDataFrame([("7", "one two"), (None, "one")], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        found = alignment.align(table, A, B)
        assert found.schema["doc_id"].dataType.simpleString() == kind and sorted(r.n_groups for r in found.collect()) == [1, 2]


def test_groups_by_dividing_are_all_common_ends():
    rng = random.Random(3)
    for _ in range(200):
        ends, firsts, at = ([], []), ([0], [0]), 0
        for _ in range(rng.randint(1, 4)):
            size = rng.randint(1, 60)
            for side in (0, 1):
                own = {at + size, *(at + i for i in range(1, size) if rng.random() < rng.choice([0.1, 0.5, 0.9]))}
                ends[side].extend(sorted(own))
                firsts[side].append(len(ends[side]))
            at += size
        a, b = alignment.groups(*(np.array(x) for x in (*ends, *firsts)))
        common = sorted(set(ends[0]) & set(ends[1]))
        assert a.tolist() == [0, *(ends[0].index(c) + 1 for c in common)][:-1] and b.tolist() == [0, *(ends[1].index(c) + 1 for c in common)][:-1]


def test_long_text_without_cuts():
    """Ends that never meet: one group, found in few rounds."""
    ends = np.arange(2, 200_002, 2), np.append(np.arange(1, 200_000, 2), 200_000)
    a, b = alignment.groups(*ends, np.array([0, len(ends[0])]), np.array([0, len(ends[1])]))
    assert a.tolist() == [0] and b.tolist() == [0]


def test_spelling_of_null_text():
    found, links, first = alignment.Aligner(A, B).align(pa.array([None, "", "a"]))
    assert found["n_a"].tolist() == [0, 0, 1] and first.tolist() == [0, 0, 0, len(links)]
