"""Near duplicates (2, 7), their components, and fingerprints (4), against plain versions."""

import contextlib
import hashlib
import math
import random
import re
import threading
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from helpers import lowest, near_fingerprints, plain_near_copies, roots, simhash
from pyspark.sql import functions as F

from tabulight.llm import embedding_dedup, fingerprints, graph, near_copies, queries
from tabulight.llm import simhash as sh
from tabulight.llm.storage import let_go

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(7)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "chain": [(i, i + 1) for i in range(60)],
             "star": [(0, i) for i in range(1, 500)], "none": []}[kind]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links + [(None, 3)], "a bigint, b bigint")).collect()}
    root = roots(600, links)
    assert got == {i: root[i] for a, b in links if a != b for i in (a, b)}


def plain_simhash(rows):
    fps = [simhash(t) for _, t in rows]
    return sorted(map(repr, zip([k for k, _ in rows], fps, lowest([k for k, _ in rows], roots(len(fps), near_fingerprints(fps))), strict=True)))


@pytest.mark.parametrize("bucket", [sh.BUCKET, 1])
def test_simhash_of_odd_rows(odd, bucket):
    got = sh.near_duplicates(odd, bucket=bucket).collect()
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == plain_simhash([(r.doc_id, r.text) for r in odd.collect()])


def test_simhash_query(spark, docs):
    got = queries.op7_simhash_near_duplicates(spark, SF).collect()
    assert sorted(repr((r.doc_id, int(r.fingerprint, 16), r.component_id)) for r in got) == plain_simhash([(r.doc_id, r.text) for r in docs.collect()])
    assert all(len(r.fingerprint) == 16 for r in got)


@pytest.mark.parametrize("limit", [0, 1, 2])
@pytest.mark.parametrize("bucket", [256, 3])
def test_fingerprint_links_lose_nothing(spark, limit, bucket):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & ((1 << 64) - 1) for c in centres for _ in range(25)} | {0, (1 << 64) - 1})
    table = spark.createDataFrame([(sh.signed(f),) for f in fps], "fp bigint")
    links = sh.fingerprint_links(table, limit, bucket).collect()
    place = {sh.signed(f): i for i, f in enumerate(fps)}
    assert roots(len(fps), [(place[r.a], place[r.b]) for r in links]) == roots(len(fps), near_fingerprints(fps, limit))


def test_one_of_each_group(odd, nothing):
    rows = odd.collect()
    kept = sh.one_of_each_group(odd)
    assert kept.columns == odd.columns
    root = roots(len(rows), near_fingerprints([simhash(r.text) for r in rows]))
    groups = lowest([r.doc_id for r in rows], root)
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, {g: groups[i] for i, g in enumerate(root)}.values()))
    assert sh.one_of_each_group(nothing).count() == 0 and sh.near_duplicates(nothing).count() == 0


def test_planted_near_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(3000)]
    line = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        for copy in range(120 if group == 0 else 3):                    # Jaccard 0.7 to 1.0 with the base
            edited = [w if rng.random() > copy % 3 * 0.02 else "edit" + str(rng.random()) for w in base]
            rows.append((len(rows), " ".join(edited) + (f" {line}" if group % 2 else "")))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = plain_near_copies(rows)
    assert sorted(r.doc_id for r in near_copies.one_of_each_group(table).collect()) == expected
    assert len(expected) < len(sh.one_of_each_group(table).collect())


def test_texts_with_a_common_key_that_are_no_copies(spark):
    """All nodes of a key are compared in the end, whatever their number, and only true copies are linked."""
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(60)]
    sets = [[*rng.sample(base, 57), *(rng.getrandbits(63) for _ in range(k % 4 * 9))] for k in range(40)]
    nodes = spark.createDataFrame([(i, len(s), 0, [5], [0] * near_copies.WIDE) for i, s in enumerate(sets)],
                                  "node bigint, size bigint, fp bigint, bands array<bigint>, few array<bigint>")
    table = spark.createDataFrame(list(enumerate(sets)), "node bigint, `all` array<bigint>")
    links = near_copies.links_of(nodes, lambda wanted: table.join(wanted, "node"), 0.8).collect()
    true = [(i, j) for i in range(40) for j in range(40) if i < j and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
    assert {(r.a, r.b) for r in links} <= set(true) and roots(40, [(r.a, r.b) for r in links]) == roots(40, true)


def test_a_family_of_texts_that_are_no_copies_is_not_compared_in_all_pairs(spark, monkeypatch):
    """250 texts of one origin that share all keys: 40 are its copies, the others are linked with nothing. Pairs grow with the texts, not with their square."""
    rng, pairs, verified = random.Random(8), [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pair, *more: pairs.append(pair.count()) or verified(pair, *more))
    base = [rng.getrandbits(63) for _ in range(60)]
    sets = [base] + [[*rng.sample(base, 60 - own), *(rng.getrandbits(63) for _ in range(own))] for own in [3] * 40 + [12] * 209]
    nodes = spark.createDataFrame([(i, 60, 0, [5, 6, 7, *([8] if i == 0 else []), *([8 + i] if i else [])], [0] * near_copies.WIDE) for i in range(250)] + [(250, 9, 0, [8], [0] * near_copies.WIDE)],
                                  "node bigint, size bigint, fp bigint, bands array<bigint>, few array<bigint>")
    table = spark.createDataFrame([*enumerate(sets), (250, base[:9])], "node bigint, `all` array<bigint>")
    links = near_copies.links_of(nodes, lambda wanted: table.join(wanted, "node"), 0.8).collect()
    found = roots(251, [(r.a, r.b) for r in links])
    assert [i for i in range(251) if found[i] == found[0]] == list(range(41)) and len(set(found)) == 211
    assert sum(pairs) <= 10 * 250                                     # all of them: 31,125


def test_a_family_whose_texts_have_little_of_their_own_is_not_compared_in_all_pairs(spark, monkeypatch):
    """240 texts of an origin that is not among them, each with 6 shingles of its own, too few to keep it from any other, and 6 of the origin's missing; only a group of copies is linked."""
    rng, pairs, verified = random.Random(9), [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pair, *more: pairs.append(pair.count()) or verified(pair, *more))
    base = [rng.getrandbits(63) for _ in range(60)]
    sets = [[*rng.sample(base, 54), *(rng.getrandbits(63) for _ in range(6))] for _ in range(240)]
    sets += [[*sets[0][1:], rng.getrandbits(63)] for _ in range(10)]
    nodes = spark.createDataFrame([(i, 60, 0, [5, 6, 7], [0] * near_copies.WIDE) for i in range(250)], "node bigint, size bigint, fp bigint, bands array<bigint>, few array<bigint>")
    table = spark.createDataFrame([*enumerate(sets)], "node bigint, `all` array<bigint>")
    found = roots(250, [(r.a, r.b) for r in near_copies.links_of(nodes, lambda wanted: table.join(wanted, "node"), 0.8).collect()])
    true = roots(250, [(i, j) for i in range(250) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})])
    assert found == true and len(set(found)) > 100
    assert sum(pairs) <= 10 * 250                                     # all of them: 31,125


def test_odd_sketches_differ_in_no_more_places_than_sets_in_shingles(spark):
    rng, share = np.random.default_rng(3), []
    for size, own in ((1, 0), (1, 1), (40, 5), (146, 30), (300, 90), (3000, 1200)):
        both = rng.integers(0, 1 << 63, size + 2 * own).astype(np.uint64)
        a, b = both[: size + own], np.concatenate([both[:size], both[size + own:]])
        words = near_copies.odd_sketch(np.concatenate([a, b]), np.array([len(a), len(b)]))
        apart = int(np.bitwise_count(words[0] ^ words[1]).sum())
        assert apart <= 2 * own
        share.append(apart / max(1, 2 * own))
        rows = spark.createDataFrame([(0, a.view(np.int64).tolist()), (1, []), (2, b.view(np.int64).tolist())], "id int, s array<bigint>").coalesce(1)
        told = [r.o for r in rows.select("id", near_copies.odd_sketches(F.col("s")).alias("o")).orderBy("id").collect()]
        assert told == [words[0].view(np.int64).tolist(), [0] * near_copies.ODD, words[1].view(np.int64).tolist()]
    assert min(share[2:5]) > 0.7


def test_near_copies_of_other_columns(spark):
    """Map, struct and binary columns, int and string keys, equal rows many times, nulls."""
    for kind in ("int", "string"):
        rows = spark.range(300).selectExpr(f"cast(if(id % 3 = 0, null, id % 7) as {kind}) AS doc_id", "if(id % 5 = 0, null, concat('one two three four five six ', id % 2)) AS text",
                                           "map('k', named_struct('x', id % 2)) AS m", "cast('b' as binary) AS raw", "1 AS t1", "2 AS node")
        found = near_copies.one_of_each_group(rows)
        assert found.columns == rows.columns and found.count() == 3      # two texts and the null ones
        assert {r.doc_id for r in found.collect()} <= {0, 1, "0", "1"} and near_copies.one_of_each_group(rows.limit(0)).count() == 0


def test_keys_reach_the_recall_that_is_stated():
    """Sets of similarity 0.8 share a key in all but about 6 of 1,000 cases, and their fingerprints keep within the radius."""
    rng, missed, far = np.random.default_rng(1), 0, 0
    for _ in range(1500):
        values = rng.integers(0, 1 << 63, 220).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(values[:180]), np.sort(np.concatenate([values[20:180], values[200:220]]))     # 160 of 200
        _, fp, keys, few = near_copies.sketch(np.concatenate([a, b]), np.array([180, 180]))
        missed += not (keys[0] == keys[1]).any()
        nibbles = [few[i].view(np.uint8) for i in (0, 1)]
        differ = sum(int(((nibbles[0] ^ nibbles[1]) & mask > 0).sum()) for mask in (15, 240))
        far += int(np.bitwise_count(fp[0] ^ fp[1])) > near_copies.RADIUS or differ > near_copies.APART
    assert missed <= 20 and far <= 20


def plain_words(text):
    """All words of the fingerprint of a text's different five-word shingles: one bit at a time."""
    ws = text.lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in {" ".join(ws[i: i + 5]) for i in range(max(1, len(ws) - 4))}], np.uint64)
    words = [hashes, *(near_copies.mix(hashes * f) for f in near_copies.FACTORS[1:])]
    return [[2 * int((w >> np.uint64(b) & np.uint64(1)).sum()) - len(w) for b in range(64)] for w in words]


def test_keys_are_nearest_pivots_of_the_fingerprint(spark):
    """Candidates come from the SimHash fingerprint: its words, and keys by the distances of its blocks to the reference fingerprints."""
    texts = ["one", "One two three four five six", " ".join(f"w{i % 290}" for i in range(700))]
    found = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(near_copies.sketches(F.col("text"), 5).alias("s")).select("s.*").collect()
    table, size = near_copies.walsh(near_copies.BLOCK), near_copies.BLOCK
    assert (table @ table.T == size * np.eye(size)).all() and set(np.unique(table)) == {-1, 1}
    for text, row in zip(texts, found, strict=True):
        over = plain_words(text)
        assert [row.fp, *row.few] == [sh.signed(sum(1 << b for b in range(64) if w[b] > 0)) for w in over]
        flat, near = np.array(over).reshape(-1), []
        for turned in near_copies.TURNED:
            for block in range(len(flat) // size):
                place = slice(block * size, block * size + size)
                pivots = [s * p * turned[place] for p in table for s in (1, -1)]
                distance = [np.abs(flat[place])[p * flat[place] < 0].sum() for p in pivots]     # bits that differ, by their majorities
                near.append(int(np.argmin(distance)))
        assert [k & 0xFFFFFF for k in row.bands] == [a << 16 | b << 8 | c for a, b, c in zip(*[iter(near)] * 3, strict=True)]
        assert [k >> 24 for k in row.bands] == list(range(near_copies.BANDS))


def test_fingerprints_of_near_copies_keep_within_the_bits_allowed():
    rng, far = np.random.default_rng(2), 0
    for _ in range(600):
        values = rng.integers(0, 1 << 63, 220).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        _, _, _, few = near_copies.sketch(np.concatenate([values[:180], values[20:180], values[200:]]), np.array([180, 180]))
        far += int(np.bitwise_count(few[0] ^ few[1]).sum()) > near_copies.APART
    assert far <= 3


def test_pipeline_stage_finds_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    expected = set(plain_near_copies([(r.doc_id, r.text) for r in docs.collect()]))
    assert expected <= got and len(got) - len(expected) <= 0.01 * (docs.count() - len(expected))


def plain_vectors(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    pairs = [(i, j) for i in ok for j in ok if j < i and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= threshold]
    low = lowest([k for k, _ in rows], roots(len(rows), pairs))
    n = np.bincount([i for p in pairs for i in p], minlength=len(rows))
    return sorted(repr((k, int(c), g, k == g and k is not None or k is None and g is None)) for (k, _), c, g in zip(rows, n, low, strict=True))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 9))
    near = [(i, (centres[i % 12] * rng.uniform(0.5, 3) + 0.12 * rng.normal(size=9)).tolist()) for i in range(300)]
    rows = [*near, (300, None), (301, []), (302, [0.0] * 9), (303, [float("nan")] * 9), (304, [None] + [1.0] * 8), (305, [float("inf")] * 9), (None, near[0][1]),
            (None, None), (3, near[3][1]), (3, near[3][1]), (306, [1.0]), (307, [2.0]), (308, [1.0] + [0.0] * 8), (309, [-1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS node", "2 AS vector", "3 AS kept")
    got = embedding_dedup.near_duplicates(table, per_cell=8)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_vectors(rows)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0
    assert [r.n_links for r in embedding_dedup.near_duplicates(table.where("vec_id in (300, 302)")).collect()] == [0, 0]


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK_QUERIES", 32)
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(6) + 0.05 * rng.normal(size=6)).tolist()) for i in range(150)] + [(i, rng.normal(size=6).tolist()) for i in range(150, 250)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    rows = [(k, np.array(v, np.float32).astype(float).tolist()) for k, v in rows]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_vectors(rows)


@pytest.mark.parametrize("element", ["float", "double"])
def test_vectors_in_turns(spark, monkeypatch, element):
    for name, value in (("BLOCK_VECTORS", 24), ("TURN_BYTES", 1 << 17), ("TURN_SHARE", 0.5), ("PART_BYTES", 1 << 15), ("PACK_BYTES", 1 << 12), ("GATHER_BYTES", 1 << 11), ("PAIRS", 256)):
        monkeypatch.setattr(embedding_dedup, name, value)
    plans, of = [], embedding_dedup.Plan.of
    monkeypatch.setattr(embedding_dedup.Plan, "of", staticmethod(lambda *a: plans.append(of(*a)) or plans[-1]))
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 7))
    rows = [(i, (centres[i % 5] + (0.01 if i % 5 else 0.2) * rng.normal(size=7)).tolist()) for i in range(150)]
    rows += [(i, v[:6]) for i, v in rows[:20]] + [(200 + i, rng.normal(size=7).tolist()) for i in range(40)] + [(300, [0.0, 1.0]), (301, [-0.0, 1.0])]
    rows = [(k, np.array(v, np.float32 if element == "float" else float).astype(float).tolist()) for k, v in rows]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{element}>"), per_cell=4)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_vectors(rows)
    assert plans[0].turns > 1 and len(plans[0].large)


def test_disk_does_not_hold_a_copy_of_a_vector_for_each_visit(spark):
    """Vectors without links visit the most cells."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[:50] = x[50:100] * 1.01 + 0.01
    table = spark.createDataFrame(list(enumerate(x.astype(float).tolist())), "vec_id bigint, embedding array<float>")
    places = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    used = lambda: sum(f.stat().st_size for top in places for f in Path(top).rglob("shuffle_*") if f.exists())
    let_go(spark)
    before, most, over = used(), [], threading.Event()

    def watch():
        while not over.wait(0.05):
            with contextlib.suppress(OSError):
                most.append(used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    got = embedding_dedup.near_duplicates(table).agg(F.sum("n_links"), F.count("*")).first()
    over.set()
    watcher.join()
    assert tuple(got) == (100, 6000)
    assert max(most) < 20 * x.nbytes


def test_recall_on_the_test_table(spark):
    got = queries.op2_embedding_near_duplicates(spark, "/root/testdata/sf0.1").collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum() - len(x)
    assert 0.99 * links <= sum(r.n_links for r in got) <= links


def test_rare_links_do_not_shorten_the_visits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(40, 24))
    noise -= (noise * x[:40]).sum(axis=1, keepdims=True) * x[:40]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.99, size=(40, 1))
    every = np.concatenate([x, cosine * x[:40] + np.sqrt(1 - cosine ** 2) * noise])
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows.tolist())), "node bigint, vector array<double>")
    options = {"threshold": 0.9, "recall": 0.999, "sample": 20_000, "queries": 1_000, "per_cell": 6, "largest": 256, "least": 4}
    without, rare = (embedding_dedup.fit(frame(rows), **options) for rows in (x, every))
    assert rare.visits >= 0.5 * without.visits > 4
    got = embedding_dedup.near_duplicates(frame(every).withColumnsRenamed({"node": "vec_id", "vector": "embedding"}), per_cell=6)
    assert sum(r.n_links for r in got.collect()) >= 0.99 * ((every @ every.T >= 0.9).sum() - len(every))


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    index = embedding_dedup.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    a, b = index.distances(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for visits in (1, 4, 35):
        assert (index.traverse(x, visits) == total.argsort(axis=1, kind="stable")[:, :visits]).all()


def edits(rows):
    out = []
    for i, (key, text) in enumerate(rows):
        last, following = len(text) // 4, rows[(i + 1) % len(rows)][1]
        out.append((key, len(text), hashlib.sha256((text[: len(text) - last] + following[:last]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part_rows", [7, 20_000])
def test_edited_texts(docs, part_rows):
    got = fingerprints.compare_edits(docs, part_rows=part_rows).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in got] == edits(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert np.median([r.near_edited for r in got]) > 0.6 and np.median([r.near_next for r in got]) < 0.2


@pytest.mark.parametrize("part_rows", [2, 5, 100])
def test_edited_texts_of_odd_rows(odd, nothing, part_rows):
    got = fingerprints.compare_edits(odd, part_rows=part_rows).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    assert sorted(map(repr, ((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in got))) == sorted(map(repr, edits(rows)))
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.n_chars if r.doc_id in (1, 2, None) and r.n_chars > 99 else r.doc_id, set()).add(bytes(r.fingerprint))
    assert all(len(v) == 1 for k, v in by_text.items() if k is not None)
    assert fingerprints.compare_edits(nothing).count() == 0
    one = fingerprints.compare_edits(odd.where("doc_id = 9")).first()
    assert one.edited == "x" and one.near_next == 1.0
    assert fingerprints.compare_edits(odd.where("doc_id is null"), part_rows=1).count() == 2


def test_fingerprints_are_sums_of_paragraphs(spark):
    f = lambda t: fingerprints.fingerprint(F.lit(t))
    a, b, c = "the first of all paragraphs", "another paragraph, quite different", "and a third one that closes"
    row = spark.range(1).select(
        f(f"{a}\n{b}\n{c}").alias("abc"), f(f"{c}\n\n  {a} \n{b}").alias("cab"), fingerprints.add(fingerprints.add(f(a), f(c)), f(b)).alias("sum"),
        fingerprints.remove(f(f"{a}\n{b}\n{c}"), f(b)).alias("less"), f(f"{a}\n{c}").alias("ac"), f(f"{a}\n{a}").alias("aa"), f(a).alias("a"),
        f("").alias("empty"), f(None).alias("null"), f(" \n\t").alias("blank"), fingerprints.remove(f(a), f(a)).alias("zero")).first()
    assert row.abc == row.cab == row.sum and row.less == row.ac and row.aa != row.a and row.a != row.ac
    assert row.empty == row.null == row.blank == row.zero == bytearray(fingerprints.WIDTH)


M64 = (1 << 64) - 1


def plain_mix(v):
    v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & M64
    v = (v ^ v >> 27) * 0x94D049BB133111EB & M64
    return v ^ v >> 31


def plain_word(word):
    total, power = len(word) * 0xD6E8FEB86659FD93, 1
    for byte in word:
        power = power * 0x9E3779B97F4A7C15 & M64
        total += (byte + 1) * power
    return plain_mix(total & M64)


def plain_fingerprint(text):
    """(exact lanes, sketch lanes) paragraph by paragraph, word by word."""
    exact, sketch = [0] * fingerprints.EXACT, [0] * fingerprints.LANES
    for line in text.encode().split(b"\n"):
        line = line.strip(b" \t\n\v\f\r")
        if not line:
            continue
        digest = hashlib.blake2b(line, digest_size=64).digest()
        exact = [(x + int.from_bytes(digest[8 * i: 8 * i + 8], "little")) & M64 for i, x in enumerate(exact)]
        hashes = [plain_word(w) for w in re.split(rb"[ \t\n\v\f\r]+", line)]
        for at in range(max(1, len(hashes) - 2)):
            value = 0
            for k in range(3):
                value = plain_mix(value * 3 + (hashes[at + k] if at + k < len(hashes) else 0) & M64)
            sketch[value % len(sketch)] += 1 - 2 * (value >> 63)
    return exact, [(x + 0x8000) % 0x10000 - 0x8000 for x in sketch]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    dot, norm = sum(x * y for x, y in zip(a[1], b[1])), math.sqrt(sum(x * x for x in a[1]) * sum(y * y for y in b[1]))
    return min(1.0, max(0.0, dot / norm)) if norm else 0.0


def test_fingerprints_and_likeness_of_documents(docs):
    """The whole result against a version that goes word by word."""
    got = fingerprints.compare_edits(docs, part_rows=50).orderBy("doc_id").collect()
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    plain = [plain_fingerprint(t) for t in texts]
    for i, r in enumerate(got):
        edited = plain_fingerprint(r.edited)
        for raw, (exact, sketch) in ((r.fingerprint, plain[i]), (r.edited_fingerprint, edited)):
            assert bytes(raw) == b"".join(x.to_bytes(8, "little") for x in exact) + b"".join((x & 0xFFFF).to_bytes(2, "little") for x in sketch)
        assert math.isclose(r.near_edited, plain_likeness(plain[i], edited), abs_tol=1e-12)
        assert math.isclose(r.near_next, plain_likeness(plain[i], plain[(i + 1) % len(plain)]), abs_tol=1e-12)


def test_different_texts_have_different_fingerprints(spark):
    line = bytearray(b"ab" * 40_000)
    line[5], line[5 + 65_536] = ord("x"), ord("y")
    swapped = bytearray(line)
    swapped[5], swapped[5 + 65_536] = line[5 + 65_536], line[5]
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4_096))
    texts = [line.decode(), swapped.decode(), thue, thue.translate({97: "b", 98: "a"})]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprints.fingerprint(F.col("t")).alias("f")).collect()
    assert len({bytes(r.f) for r in found}) == 4


@pytest.mark.parametrize("kind", ["int", "string", "double", "decimal(20,2)", "date", "timestamp", "binary"])
def test_keys_of_any_type(spark, kind):
    as_key = {"date": "date_add(date'2020-01-01', cast(k as int))", "timestamp": "timestamp_seconds(k * 1000003)", "binary": "cast(printf('%04d', k) as binary)",
              "string": "printf('doc-%04d', k)"}.get(kind, f"cast(k as {kind})")
    rows = spark.range(60).selectExpr("id as k", "concat('text ', id, ' of ', 1000 - id) as text").orderBy("text")
    got = fingerprints.compare_edits(rows.selectExpr(f"{as_key} as doc_id", "text"), part_rows=9)
    assert got.schema["doc_id"].dataType.simpleString() == kind
    plain = edits([(k, f"text {k} of {1000 - k}") for k in range(60)])
    assert [hashlib.sha256(r.edited.encode()).hexdigest() for r in got.orderBy("doc_id").collect()] == [e for _, _, e in plain]


def test_rows_of_one_key_are_cut(spark):
    """Rows without a key, and of one key, go to many parts; their order is that of their texts."""
    rows = spark.range(900).selectExpr("case when id < 300 then null when id < 600 then 7 else id end as doc_id", "concat(sha2(cast(id as string), 256), ' tail') as text")
    parts, _ = fingerprints.with_next(rows, part_rows=30)
    for one in ("doc_id is null", "doc_id = 7"):
        assert parts.where(one).select("part").distinct().count() > 4
    got = sorted((r.doc_id or -1, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in fingerprints.compare_edits(rows, part_rows=30).collect())
    assert got == sorted((k or -1, n, h) for k, n, h in edits(sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))
