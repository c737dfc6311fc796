"""Source divergence (11) against a plain version and SQL."""

import random
import re
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest

from tabulight.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least=10, top=10):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for _, x, ts in own if x == s for t in ts) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())

        def levels(count, kept=kept):
            total = sum(count[t] for t in kept)
            return [1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept]

        p, q = {s: levels(c) for s, c in counts.items()}, levels(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(x, sum(map(f, p[s], p[x]))) for x in counts if x != s]
            terms = [(t, f(a, b)) for t, a, b in zip(kept, p[s], q, strict=True) if counts[s][t] and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[: top if part == "term" else None])]
    return sorted(out)


def rows_of(found):
    return sorted(tuple(r) for r in found.select(*COLUMNS).collect())


def test_audit_of_documents(spark, docs):
    got = rows_of(queries.op11_source_divergence(spark, SF))
    assert got == plain_audit([(r.text, r.lang, r.source) for r in docs.collect()])
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(db.sql(queries.OP11_SQL).fetchall()) == got


@pytest.mark.parametrize(("least", "shard", "wave", "block", "tile"), [(1, 2, 200, 2, 1), (2, 100, 1 << 20, 3, 2), (99, 10, 100, 4, 4)])
def test_audit_of_odd_rows(spark, odd, least, shard, wave, block, tile):
    got = divergence.audit(odd, least=least, top=3, shard=shard, wave=wave, block=block, tile=tile)
    assert rows_of(got) == plain_audit([(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()], least, 3)


def test_audit_of_nothing(nothing):
    assert divergence.audit(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_transducer_is_minimal_and_gives_places(n):
    rng = random.Random(n)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))).encode() for _ in range(n)})
    machine = divergence.Transducer.from_bytes(divergence.Transducer(words).to_bytes())
    asked = [*words, b"a", b"zz", b"abab\xc3", *(w + b"a" for w in words[:20])]
    ends = np.cumsum([len(w) for w in asked])
    got = machine.ordinals(np.frombuffer(b"".join(asked), np.uint8), np.append(0, ends[:-1]), ends)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked] and [machine.spell(i) for i in range(len(words))] == words
    # As many states as there are different sets of rests (and the start of an empty automaton).
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    rests = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert len(machine.final) == max(1, len(rests))


def test_levels_beyond_64_bits(spark):
    n, total, size = 5 * 10**14, 9 * 10**14, 10**6
    exact = 1 + 10**9 * (n + 2) // (total + 2 * size)
    assert divergence.levels(np.array([n]), np.array([total]), size).tolist() == [exact]
    row = spark.createDataFrame([(n, total, size)], "n bigint, total bigint, size bigint")
    assert row.select(divergence.level(row.n, row.total, row.size)).first()[0] == exact


def test_ranks_are_without_gaps(spark):
    found = queries.op11_source_divergence(spark, SF).select(*COLUMNS).orderBy(*COLUMNS[:3], "rank").collect()
    for _, own in groupby(found, key=lambda r: r[:3]):
        own = list(own)
        assert [r.rank for r in own] == [*range(1, len(own) + 1)] and all(a.value >= b.value for a, b in zip(own, own[1:], strict=False))
