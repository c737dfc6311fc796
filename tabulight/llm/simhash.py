"""Near-duplicate texts by SimHash fingerprints, compared by pivot distance tables.

Every distinct fingerprint gets a row of a pivot table: its Hamming distances to the zero fingerprint and to reference
fingerprints that lie within one of four blocks of 16 bits each. Distances change by at most as much as the fingerprint
does, so a pair with a coordinate that differs by more than the limit is no link.

The table also finds the pairs to look at. The distance to a pivot less that to zero depends on the bits of the pivot's
block alone, and two fingerprints at most two bits apart agree in at least two blocks. So all links lie in buckets of
fingerprints with equal coordinates in a pair of blocks: six buckets for a fingerprint. In a bucket the pairs are discarded by
their largest coordinate difference, and the survivors are verified.

A bucket with more than ``BUCKET`` fingerprints is not compared pair by pair. Its fingerprints are joined through the points
one bit away from them instead (``midpoint_links``), which is exact too and grows in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulight.llm.flat import SPACE, flat_text, pieces, tidied, words
from tabulight.llm.graph import components
from tabulight.llm.storage import fresh, kept

BITS, BLOCKS, WIDTH = 64, 4, 16
#: Bit patterns of the pivots of a block: half of its bits, no two alike (rows of a Walsh matrix).
PATTERNS = [sum(1 << b for b in range(WIDTH) if bin(b & row).count("1") % 2) for row in (1, 2, 4, 8, 3, 5, 9, 15)]
BUCKET = 256


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def pivots() -> list[int]:
    """The reference fingerprints, zero first, as signed 64-bit integers."""
    return [0, *(signed(p << (WIDTH * block)) for block in range(BLOCKS) for p in PATTERNS)]


def shingle_spans(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered and words one space apart; start and end of each shingle; each text's number of shingles."""
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    space = SPACE[data]
    data[space] = 0x20
    starts, ends, first = words(data, offsets)
    keep = ~space
    keep[ends[ends < len(data)]] = True                             # one separator stays after each word
    place = np.cumsum(keep) - keep
    starts, ends = place[starts], place[ends - 1] + 1
    count = np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.repeat(first[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = np.minimum(begin + size, np.repeat(first[1:], shingles)) - 1
    return data[keep], starts[begin], ends[last], shingles


def fingerprint_piece(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    import xxhash

    flat, starts, ends, count = shingle_spans(data, offsets, size)
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    out, full = np.zeros((len(count), BITS), bool), count > 0
    if full.any():
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
        out[full] = 2 * ones > count[full, None]
    return np.packbits(out, axis=1).reshape(-1).view(">u8").astype(np.int64)


def simhash(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text (bigint): a bit is set if it is set in over half of the shingles' hashes.

    A-Z are lowered, words are runs of other bytes than white space, shingles are ``shingle`` words with a space between
    (all words if there are fewer), repeats included, hashed by XXH64 with seed 42. A null text or one without words has zero.
    """
    @F.arrow_udf("bigint")
    @tidied
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fingerprint_piece(d, o, shingle) for d, o in pieces(*flat_text(batch))]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return fingerprint(text)


def coordinates(fp: np.ndarray) -> np.ndarray:
    """Pivot table of fingerprints (rows) in numpy."""
    refs = np.array(pivots(), np.int64).view(np.uint64)
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ refs[None, :]).astype(np.int8)


def bucket_pairs(offsets: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs within each bucket, all pairs of a bucket tested by the pivot table first."""
    table = coordinates(fp)
    end = np.repeat(offsets[1:], np.diff(offsets))
    i, step, found = np.arange(len(fp)), 1, []
    while len(i):
        i = i[i + step < end[i]]
        near = i[(np.abs(table[i] - table[i + step]) <= limit).all(axis=1)]
        link = near[np.bitwise_count(fp[near].view(np.uint64) ^ fp[near + step].view(np.uint64)) <= limit]
        found.append((link, link + step))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (i, i)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is linked with, itself included, over any number of links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def bucket_links(limit: int):
    """From a bucket's fingerprints, links that connect the same of them as all links of the bucket do (fewer than members)."""
    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    @tidied
    def links(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, fp = np.asarray(batch.offsets).astype(np.int64), np.asarray(batch.values).astype(np.int64)
            fp, offsets = fp[offsets[0]: offsets[-1]] if len(offsets) else fp, offsets - offsets[0]
            root = forest(len(fp), *bucket_pairs(offsets, fp, limit))
            member = np.flatnonzero(root != np.arange(len(fp)))
            ends = np.searchsorted(member, offsets)
            pairs = pa.StructArray.from_arrays([pa.array(fp[member]), pa.array(fp[root[member]])], ["a", "b"])
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)

    return links


def pivot_keys(fp: Column) -> Column:
    """The six bucket keys of a fingerprint: for each pair of blocks, their pivots' distances less that to zero."""
    refs = pivots()
    near = F.bit_count(fp)
    at = [(F.bit_count(fp.bitwiseXOR(F.lit(p))) - near + 8).cast("bigint") for p in refs[1:]]   # 0, 2 ... 16
    at = [F.shiftright(c, 1) for c in at]
    of = lambda block: at[block * len(PATTERNS): (block + 1) * len(PATTERNS)]
    packed = lambda cs: reduce(lambda key, c: key * 9 + c, cs, F.lit(0).cast("bigint"))
    pairs = [(x, y) for x in range(BLOCKS) for y in range(x + 1, BLOCKS)]
    return F.array(*(F.struct(F.lit(k).alias("pair"), packed(of(x) + of(y)).alias("key")) for k, (x, y) in enumerate(pairs)))


def midpoint_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints (column ``fp``) two bits apart or fewer, without comparing pairs.

    Two such fingerprints share a point that is at most one bit from both. Each one names itself and its 64 neighbours; all
    that name the same point (at most 65) are linked with the smallest of them, which is two bits away or less.
    """
    point = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)))
    named = fps.select("fp", F.explode(point).alias("z"))
    low = named.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("top"), F.collect_set("fp").alias("all")).where("b <> top")
    return low.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def fingerprint_links(fps: DataFrame, limit: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (``a``, ``b``) that connect the distinct fingerprints of column ``fp`` as all pairs ``limit`` bits apart do.

    ``limit`` is 0, 1 or 2: four blocks with two equal ones allow no more.
    """
    if limit not in (0, 1, 2):
        raise ValueError("fingerprints link at 0, 1 or 2 differing bits")
    keyed = kept(fps.select("fp", F.explode(pivot_keys(F.col("fp"))).alias("k")).select("fp", "k.pair", "k.key"))
    sizes = keyed.groupBy("pair", "key").count().where("count > 1")
    small = keyed.join(sizes.where(F.col("count") <= bucket).drop("count"), ["pair", "key"])
    links = small.groupBy("pair", "key").agg(F.collect_list("fp").alias("fps"))         # at most ``bucket`` each
    links = links.select(F.explode(bucket_links(limit)("fps")).alias("l")).select("l.a", "l.b")
    crowd = keyed.join(sizes.where(F.col("count") > bucket).drop("count"), ["pair", "key"]).select("fp").distinct()
    if limit == 2:
        return links.unionByName(midpoint_links(crowd))
    near = crowd.select(F.col("fp").alias("a"), F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)))).alias("b"))
    exact = near.join(crowd.select(F.col("fp").alias("b")), "b").where("a > b").select("a", "b")
    return links.unionByName(exact if limit else exact.limit(0))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, limit: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (bigint), ``component_id``.

    component_id is the smallest key of the documents reachable by links, itself included. Null and empty texts have
    fingerprint zero and link like any other. A null key never becomes a component's id, unless all of its keys are null: then
    the id is null. Repeated rows give repeated rows. An empty table gives an empty one. Other columns are not read.
    """
    marked = kept(docs.select(F.col(key).alias("doc_id"), simhash(F.col(text), shingle).alias("fp")))
    return components_of(marked, limit, bucket)


def components_of(marked: DataFrame, limit: int, bucket: int) -> DataFrame:
    """component_id for rows of ``doc_id``, ``fp``."""
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(fingerprint_links(distinct, limit, bucket))
    owner = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = owner.groupBy("root").agg(F.min("low").alias("component_id"))
    owner = kept(owner.join(lowest, "root").select("fp", "component_id"))
    return marked.join(owner, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, limit: int = 2) -> DataFrame:
    """The documents without near duplicates: of each component, the row with the smallest key stays, nulls last.

    Rows that share that key are ordered by a hash of all their columns; equal rows count as one. All columns stay.
    """
    fp, tag = fresh(docs.columns, "fp", "tag")
    every = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    rows = docs.withColumn(tag, F.xxhash64(*every)).withColumn(fp, simhash(F.col(text), shingle))
    marked = kept(rows.select(F.col(key).alias("doc_id"), F.col(tag).alias("tag"), F.col(fp).alias("fp")))
    distinct = kept(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")))
    roots = components(fingerprint_links(distinct.select("fp"), limit, BUCKET))
    owner = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    winner = owner.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("win_id"), F.col("first.tag").alias("win_tag"))
    winner = kept(winner.distinct())
    chosen = docs.withColumn(tag, F.xxhash64(*every)).join(
        winner, F.col(key).eqNullSafe(F.col("win_id")) & (F.col(tag) == F.col("win_tag")), "left_semi").drop(tag)
    return chosen.dropDuplicates()
