"""Repeated passages (12) against a plain version."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulight.llm import passages, queries
from tabulight.llm.storage import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_removal(rows, window=35):
    split = [(key, WORD.findall(text or "")) for key, text in rows]
    count, out = Counter(tuple(w[i: i + window]) for _, w in split for i in range(len(w) - window + 1)), []
    for key, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i: i + window])] > 1:
                gone[i: i + window] = [True] * window
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_passages_of_documents(spark, docs):
    got = [tuple(r) for r in queries.op12_repeated_passages(spark, SF).collect()]
    expected = plain_removal([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got) == sorted((k, n, r, hashlib.sha256(t.encode()).hexdigest()) for k, n, r, t in expected) and sum(r[2] for r in got) > 1000
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(db.sql(queries.OP12_SQL).fetchall()) == sorted(got)


@pytest.mark.parametrize(("part_bytes", "automaton"), [(1, 300_000), (5_000, 40), (4 << 20, 300_000)])
def test_passages_of_odd_rows(spark, odd, part_bytes, automaton):
    got = passages.remove_repeats(odd, part_bytes=part_bytes, automaton=automaton).collect()
    assert in_order(got) == in_order(plain_removal([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]))


def test_passages_of_nothing_and_other_keys(spark, nothing):
    assert passages.remove_repeats(nothing).count() == 0
    for kind in ("int", "string"):
        table = spark.createDataFrame([("7", "a b c"), (None, "b a b c"), ("8", None)], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "map(1, 2) AS m")
        found = passages.remove_repeats(table, window=3, anchor=2)
        assert found.schema["doc_id"].dataType.simpleString() == kind and sorted((r.n_removed, r.kept) for r in found.collect()) == [(0, ""), (3, ""), (3, "b")]


@pytest.mark.parametrize("seed", range(4))
def test_few_different_words(spark, seed):
    """Texts full of repeats within and between them, in several parts and automata."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(texts[i] + " " + texts[j] for i, j in [rng.sample(range(60), 2)]) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = passages.remove_repeats(table, window=6, anchor=2, part_bytes=rng.choice([1, 300, 10**6]), automaton=rng.choice([6, 50, 10**6])).collect()
    assert in_order(got) == in_order(plain_removal(enumerate(texts), 6))


def test_passage_longer_than_an_automaton():
    number, first = np.array([*range(50), 99, *range(50), 98]), np.array([0, 51, 102])
    for limit in (1, 7, 20, 1000):
        gone = passages.located(number, 100, first, [(0, 50)], 7, limit)
        assert gone.tolist() == [True] * 50 + [False] + [True] * 50 + [False]


def test_many_different_words_have_wider_signs():
    raw, width = passages.spell(np.arange(300_000), 300_000)
    assert width == 4 and len(raw) == 4 * 300_000 and len({raw[i: i + 4] for i in range(0, len(raw), 4)}) == 300_000


def test_regions_leave_nothing_and_texts_are_dealt_once(spark):
    """The shared folder ends with the packed texts and what repeats, not with all regions, and the texts are not shuffled again by part."""
    rng, folder = random.Random(5), Path(shared_folder(spark).removeprefix("file:"))
    texts = [" ".join(f"w{rng.randrange(100_000)}" for _ in range(6_000)) for _ in range(50)]
    size, there = sum(map(len, texts)), set(folder.rglob("*"))
    found = passages.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert found.agg(F.sum("n_words"), F.sum("n_removed")).first() == (300_000, 0)
    assert sum(f.stat().st_size for f in set(folder.rglob("*")) - there if f.is_file()) < 0.8 * size
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(part#" in line]
