"""Near copies of texts: pairs whose sets of word shingles have a Jaccard similarity of 0.8 or more, by fingerprints and pivot distances.

Each text gets, in one pass, the SimHash fingerprint of its five-word shingles: ``WORDS`` words of 64 bits, and of each bit its majority, the shingles that set it
less those that do not. The fingerprint is cut into blocks of 128 bits. The pivots of a block are 128 reference fingerprints (rows of a Walsh matrix
with some columns turned round) and their opposites; a block's distance to a pivot counts each bit that differs by its majority. A key is the nearest pivots of ``NEAREST``
blocks, under ``BANDS`` choices of columns, and texts that share a key are candidates: two of similarity 0.8 share none in 1 of 1,000 cases, of 0.85 in hardly any; two
with nothing in common share one in 6 of a million. (Fingerprints at similarity 0.8 differ by 15 of 100 bits, but hardly in those with large
majorities, which decide what pivot is nearest; equal blocks of bits would need some 300 keys for as much at as few chance pairs.) Texts with equal sets of shingles are one node.

A pair is discarded if a coordinate of the pivot table of its first words differs by more than
``RADIUS``, then if the words do or if more than ``APART`` bits of the others differ; survivors are verified on all their shingles.
RADIUS is 3.6 standard deviations beyond the mean at similarity 0.8 (9.7 bits, deviation 2.9), and so is APART (145 bits, deviation 11): 4 of 10,000 such pairs are lost by them. The first
``NARROW`` of the other words are looked at before pairs are written down.

Nodes with a common key are compared with some of them, not all with all. First each node meets one other, the node with most company in any of its keys; then those of a key
meet some sixteen of them, 256 and so on, each pair once, and only where no link has connected them by then. A group of copies is connected after a turn or two, so its pairs
never meet. Before the second turn the shingles are read of the nodes that still have anything to meet. Those that a node shares with none of the others bound its similarity to
all of them, and an odd sketch (for each of ``64 * ODD`` places whether an odd number of the shingles fall on it) that of two: places that differ are no more than the shingles that do.
So texts of one origin that are no copies do not meet either, and nothing is lost by it. All other texts that share a key are compared in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulight.llm.flat import mix, text_pieces, tidied
from tabulight.llm.graph import components
from tabulight.llm.simhash import BITS, pivots, shingle_spans
from tabulight.llm.storage import fresh, kept, let_go

WORDS, BLOCK = 16, 128
BANDS, NEAREST, RADIUS = 96, 3, 20
#: Words beside the first one; by how many of their bits two texts may differ.
WIDE, APART = WORDS - 1, 186
#: How many times more nodes of a key are compared with the others in each turn.
STEP = 16
#: Keys of so many nodes are sent to all tasks.
FEW_NODES = 50_000
#: Words that rows of keys carry, to discard pairs before they are written; by how many of their bits two texts may differ (3.8 deviations).
NARROW, NARROW_APART = 3, 48
#: Words of the odd sketch; 512 places tell apart sets that differ by up to some 500 shingles.
ODD = 8
#: How often the columns of all blocks are turned round, and which.
TURNS = BANDS * NEAREST * BLOCK // (WORDS * BITS)
TURNED = (1 - 2 * (mix(np.arange(1, TURNS * WORDS * BITS + 1)) & np.uint64(1)).astype(np.float32)).reshape(TURNS, WORDS * BITS)
#: Odd factors that make the words of a shingle from its hash.
FACTORS = mix(np.arange(1, WORDS + 1)) | np.uint64(1)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles in order, and each text's number of them."""
    import xxhash

    flat, starts, ends, count = shingle_spans(data, offsets, size)
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(count))


def lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values.view(np.int64)))


def shingles(text: Column, size: int) -> Column:
    """array<bigint>: the hashes of a text's different shingles; none for a null text or one without words."""
    @F.arrow_udf("array<bigint>")
    @tidied
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for data, offsets in text_pieces(batch):
                yield lists(*distinct_shingles(data, offsets, size))

    return found(text)


def majorities(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text (rows, none of them without shingles) and bit of the fingerprint, the shingles that set it less those that do not."""
    first, size = np.cumsum(count) - count, -(-count // 255)                # bits are added up in bytes, at most 255 of them
    begin = np.cumsum(size) - size
    edges = np.repeat(first, size) + 255 * (np.arange(size.sum()) - np.repeat(begin, size))
    ones, low = np.zeros((len(count), WORDS, 8, 8), np.int32), np.uint64(0x0101010101010101)
    for k, factor in enumerate(FACTORS):
        word = mix(hashes * factor) if k else hashes
        for shift in range(8):
            lanes = np.add.reduceat((word >> np.uint64(shift)) & low, edges).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, k, :, shift] = np.add.reduceat(lanes, begin, axis=0, dtype=np.int32)
    return 2 * ones.reshape(len(count), WORDS * BITS) - count.astype(np.int32)[:, None]


def walsh(size: int) -> np.ndarray:
    """The Walsh matrix of a power of two."""
    rows = np.ones((1, 1), np.float32)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows


def pivot_keys(over: np.ndarray) -> np.ndarray:
    """The keys of texts (rows) from the majorities of their bits: the nearest pivots of each ``NEAREST`` blocks, with the key's number."""
    near, pivots_of_block = [], walsh(BLOCK)
    for turned in TURNED:
        distance = (over * turned).reshape(-1, BLOCK) @ pivots_of_block     # the less, the farther; a pivot's opposite has the same with another sign
        best = np.abs(distance).argmax(axis=1)
        near.append((2 * best + (distance[np.arange(len(best)), best] < 0)).reshape(len(over), -1))
    near = np.concatenate(near, axis=1).reshape(len(over), BANDS, NEAREST)
    keys = np.broadcast_to(np.arange(BANDS), near.shape[:2])
    for k in range(NEAREST):
        keys = keys * (2 * BLOCK) + near[:, :, k]
    return keys.astype(np.uint64)


def sketch(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's shingles: two hashes of the set (rows), the fingerprint's first word; of those with shingles the keys and the other words."""
    first, full = np.cumsum(count) - count, count > 0
    sums, fp = np.zeros((2, len(count)), np.uint64), np.zeros(len(count), np.uint64)
    if not full.any():
        return sums, fp, np.zeros((0, BANDS), np.uint64), np.zeros((0, WIDE), np.uint64)
    edges = first[full]
    for row, salt in zip(sums, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
        row[full] = np.add.reduceat(mix(hashes + np.uint64(salt)), edges)
    over = majorities(hashes, count[full])
    bits = np.packbits(over > 0, axis=1, bitorder="little").view("<u8").astype(np.uint64)
    fp[full] = bits[:, 0]
    return sums, fp, pivot_keys(over.astype(np.float32)), np.ascontiguousarray(bits[:, 1:])


def sketches(text: Column, size: int) -> Column:
    """struct<h1, h2, size, fp, bands, few>: two hashes of the set of shingles, its size, the fingerprint's first word, the keys, the other words."""
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("few", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<h1: bigint, h2: bigint, size: bigint, fp: bigint, bands: array<bigint>, few: array<bigint>>")
    @tidied
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for data, offsets in text_pieces(batch):
                hashes, count = distinct_shingles(data, offsets, size)
                sums, fp, keys, few = sketch(hashes, count)
                yield pa.StructArray.from_arrays(
                    [pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(count.astype(np.int64)), pa.array(fp.view(np.int64)),
                     *(lists(x.reshape(-1), np.where(count > 0, x.shape[1], 0)) for x in (keys, few))], fields=list(kind))

    return found(text)


def odd_sketch(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each set (rows) and place whether an odd number of its shingles fall on the place."""
    place = np.repeat(np.arange(len(count)) * (64 * ODD), count) + (mix(hashes) & np.uint64(64 * ODD - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(count) * 64 * ODD).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").astype(np.uint64).reshape(len(count), ODD)


def odd_sketches(hashes: Column) -> Column:
    """array<bigint>: the ``ODD`` words of the odd sketch of a set of shingles."""
    @F.arrow_udf("array<bigint>")
    @tidied
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            count = batch.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = odd_sketch(batch.flatten().to_numpy(zero_copy_only=False).view(np.uint64), count)
            yield lists(words.reshape(-1), np.full(len(count), ODD))

    return found(hashes)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose sets of shingles (``node``, ``all``) are similar enough."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("all").alias(f"all_{name}"))
    both = F.size(F.array_intersect("all_a", "all_b"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("all_a") + F.size("all_b")).alias("sum"))
    return found.where(F.col("both") / (F.col("sum") - F.col("both")) >= least).select("a", "b")


def not_too_far(x: Column, y: Column, radius: int) -> Column:
    """Whether two fingerprints differ by ``radius`` bits or fewer; the pivots' coordinates, which differ by less, are looked at first."""
    far = [F.abs(F.bit_count(x.bitwiseXOR(F.lit(p))) - F.bit_count(y.bitwiseXOR(F.lit(p)))) for p in pivots()[::8]]
    return (reduce(F.greatest, far) <= radius) & (F.bit_count(x.bitwiseXOR(y)) <= radius)


def bits_apart(x: Column, y: Column, words: int) -> Column:
    """How many bits of two arrays of words differ."""
    return reduce(lambda a, b: a + b, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(words)))


def alone(sets: DataFrame) -> DataFrame:
    """``node``, ``own``: how many shingles each of the ``sets`` (``node``, ``all``) has that no other of them has; no row for none."""
    counts = sets.select("node", F.explode("all").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return counts.where("n = 1").groupBy("node").agg(F.count("*").cast("int").alias("own"))


def similar_at_most(x: str, y: str) -> tuple[Column, Column]:
    """Bounds of two sets of ``size`` shingles, ``own`` of which the other cannot have: the most that they share, and the least that they have together."""
    size, own = (lambda side: F.col(f"{side}.size")), (lambda side: F.col(f"{side}.own"))
    return F.least(size(x) - own(x), size(y) - own(y)), F.greatest(size(x) + own(y), size(y) + own(x))


def share(node: Column) -> Column:
    """A number in [0, 1) for a node, evenly spread: the order in which nodes are compared with others."""
    return F.shiftrightunsigned(F.xxhash64(node), 11) / float(1 << 53)


def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` for rows of ``node``: nodes with one label are connected by links. Far ends of a chain may still have two; that costs a comparison only.

    Everyone takes the smallest name among its neighbours and itself, three times over.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
    for _ in range(2):
        seen = both.join(names.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        names = names.join(seen, "node").select("node", F.least("label", "low").alias("label"))
    return rows.join(names, "node", "left").withColumn("label", F.coalesce("label", "node"))


def links_of(nodes: DataFrame, sets_of, least: float, radius: int = RADIUS) -> DataFrame:
    """Links (``a``, ``b``) that connect the nodes (``node``, ``size``, ``fp``, ``bands``, ``few``) as all similar pairs with a common key do.

    ``sets_of`` gives ``node``, ``all`` for a frame of nodes. All links are true ones.
    """
    named = nodes.select("node", F.explode("bands").alias("key"))
    sizes = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = kept(named.join(sizes, "key").select("key", "node", "n"))
    # What a group of copies was made from shares more keys with them than they do with each other, so the node with most company is asked first.
    company = found.groupBy("node").agg(F.sum("n").alias("company"))
    told = kept(company.join(nodes.select("node", "size", "fp", "few"), "node"))
    shared = kept(found.join(told, "node").select("key", "node", F.col("size").cast("int").alias("size"), "fp", F.col("n").cast("int").alias("n"),
                                                   F.slice("few", 1, NARROW).alias("few"), F.lit(0).alias("own")))
    rank = F.struct((-F.col("company")).alias("company"), share(F.col("node")).alias("share"), "node")
    firsts = found.join(company, "node").groupBy("key").agg(F.min(rank).alias("first"))
    asked = found.join(firsts, "key").groupBy("node").agg(F.min("first").alias("first")).select("node", F.col("first.node").alias("first")).where("node <> first")

    def near(x: str, y: str, words: int, apart: int) -> Column:
        both, together = similar_at_most(x, y)
        return (both >= F.lit(least) * together - 1e-6) & not_too_far(F.col(f"{x}.fp"), F.col(f"{y}.fp"), radius) & (bits_apart(F.col(f"{x}.few"), F.col(f"{y}.few"), words) <= apart)

    def passed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that all words of the fingerprint let pass."""
        side = lambda name: told.select(F.col("node").alias(name), F.struct("size", "fp", "few", F.lit(0).alias("own")).alias(f"of_{name}"))
        return kept(pairs.join(side("a"), "a").join(side("b"), "b").where(near("of_a", "of_b", WIDE, APART)).select("a", "b"))

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # Most nodes meet others by chance only, so the shingles are asked for when a pair has passed.
    pair = passed(asked.select(*ordered("node", "first")).distinct())
    sets = kept(sets_of(pair.select(F.col("a").alias("node")).unionByName(pair.select(F.col("b").alias("node"))).distinct()))
    links, own, odd = kept(verified(pair, sets, least)), F.coalesce("own", F.lit(0)).alias("own"), odd_sketches(F.col("all")).alias("odd")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & near("x", "y", NARROW, NARROW_APART)
    differ = (F.col("x.size") + F.col("y.size")) * ((1 - least) / (1 + least)) + 1e-6      # shingles that only one of two sets so similar has, at most

    def undecided(rows: DataFrame) -> DataFrame:
        """The rows of keys that hold several labels."""
        rows = labelled(rows, links)
        several = rows.groupBy("key").agg((F.min("label") != F.max("label")).alias("open")).where("open").drop("open")
        return kept(rows.join(several, "key"))

    def unmet(rows: DataFrame, apart: Column) -> DataFrame:
        """The rows that another one of their key may be similar to."""
        return kept(rows.alias("x").join(rows.alias("y"), apart, "left_semi"))

    let_go(nodes.sparkSession)
    rows = unmet(undecided(shared), apart)
    ends = kept(rows.select("node").distinct())
    missing = kept(ends.join(sets, "node", "left_anti"))
    if not missing.isEmpty():
        sets = sets.unionByName(kept(sets_of(missing)))
    open_sets = kept(sets.join(ends, "node"))
    told_more = open_sets.select("node", odd).join(alone(open_sets), "node", "left").select("node", own, "odd")
    apart &= bits_apart(F.col("x.odd"), F.col("y.odd"), ODD) <= differ
    rows = unmet(kept(rows.drop("own").join(told_more, "node")), apart)
    # How many of a key are left; from now on the same, since it tells whose turn it is.
    rows, turn = kept(rows.drop("n").join(rows.groupBy("key").agg(F.count("*").cast("int").alias("n")), "key")), 1
    let_go(nodes.sparkSession)
    while (most := rows.agg(F.max("n")).first()[0]) is not None:
        place = share(F.col("node")) * F.col("n")
        some = rows.where((place >= (STEP ** (turn - 1) if turn > 1 else 0)) & (place < STEP ** turn))
        after = F.struct(share(F.col("x.node")), F.col("x.node")) > F.struct(share(F.col("y.node")), F.col("y.node"))     # else they met when x was among the some
        pair = passed(rows.alias("x").join(some.alias("y"), apart & after).select(*ordered("x.node", "y.node")).distinct())
        links = kept(links.unionByName(verified(pair, sets, least)))
        if STEP ** turn >= most:
            break
        rows, turn = unmet(undecided(rows.drop("label")), apart), turn + 1
        let_go(nodes.sparkSession)
    return links


def hashable(frame: DataFrame, name: str) -> Column:
    """The column, as text where its type holds a map, which Spark can neither hash nor group."""
    column = F.col(f"`{name.replace('`', '``')}`")
    return column.cast("string") if "map<" in frame.schema[name].dataType.simpleString() else column


def one_of_each_group(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each group connected by pairs of similarity ``least``, the row with the smallest key, nulls last.

    A-Z are lowered, words are runs of other bytes than white space, a shingle is ``shingle`` words (all if there are fewer). Null texts and
    those without words are copies of each other. Long texts are taken whole. Rows that share the key are ordered by two hashes of all their
    columns; equal rows count as one. Columns of any type stay; an empty table stays empty.
    """
    t1, t2, set_of, node_of = fresh(docs.columns, "t1", "t2", "set", "node")
    every = [hashable(docs, c) for c in docs.columns]
    tags = {t1: F.xxhash64(*every), t2: F.xxhash64(F.lit(1), *every)}
    rows = docs.select(F.col(key).alias("doc_id"), tags[t1].alias("t1"), tags[t2].alias("t2"), sketches(F.col(text), shingle).alias("s"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    marked = rows.select(first.alias("first"), "s").groupBy("s.h1", "s.h2", "s.size").agg(
        F.min("first").alias("first"), F.any_value("s.fp").alias("fp"), F.any_value("s.bands").alias("bands"), F.any_value("s.few").alias("few"))
    nodes = kept(marked.select(F.monotonically_increasing_id().alias("node"), "first", "size", "fp", "bands", "few"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The shingles again, from the texts: only the nodes of pairs that passed need them."""
        own = nodes.join(wanted, "node").select(F.col("node").alias(node_of), F.col("first.t1").alias(t1), F.col("first.t2").alias(t2))
        texts = docs.select(F.col(text).alias(text), *(c.alias(n) for n, c in tags.items()))
        if wanted.count() <= FEW_NODES:                             # no text but theirs is shuffled
            texts = texts.join(F.broadcast(own), [t1, t2]).dropDuplicates([t1, t2])
        else:
            texts = texts.dropDuplicates([t1, t2]).join(own, [t1, t2])
        return texts.select(F.col(node_of).alias("node"), shingles(F.col(text), shingle).alias("all"))

    links = links_of(nodes, sets_of, least, radius)
    let_go(docs.sparkSession)
    roots = components(links)
    owner = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winner = kept(owner.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.t1").alias(t1), F.col("first.t2").alias(t2)))
    return docs.withColumns(tags).dropDuplicates([t1, t2]).join(winner, [t1, t2], "left_semi").drop(t1, t2)
