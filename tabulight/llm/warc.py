"""WARC archives: pages as records, long ones in segments, and their reassembly.

``write`` makes files that Spark's own writer lays down in any store: one record after the other, each with the two line ends that close
it. A page's HTTP response is framed in chunks (``Transfer-Encoding: chunked``). A record longer than ``segment`` bytes is continued
in further records with the number of the segment, the identifier of the record that it continues and, in the last one, the total length.
Of equal payloads of ``revisit_from`` bytes or more the one with the largest key is stored, the others are revisits that name it.

``read`` parses archives, groups continuation records by the identifier of their origin, orders them by segment number, verifies that
none is missing and that the total length is right, and decodes the chunks. Only segmented records are shuffled.

Rows
    A null page is an empty one. Keys may be null (then the record has none, and the result a null) or repeated: every row is a record with an
    identifier of its own. A null address is written as ``about:blank``; control characters and spaces in addresses are percent-encoded.
    Other columns are not read. An empty table gives an archive without records, and that an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from uuid import UUID

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SEGMENT, CHUNK = 32 << 10, 8 << 10
#: Bytes of pages in an archive file, about. A file is read as a whole.
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
#: The field that carries a row's key through the archive.
KEY_FIELD = "Source-Row-Key"


def framed(payload: bytes, chunk: int) -> bytes:
    """The payload in chunks, and the empty chunk that ends them."""
    parts = []
    for at in range(0, len(payload), chunk):
        piece = payload[at: at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken. Extensions of a chunk's size and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = re.match(rb"\s*([0-9A-Fa-f]+)\s*(;|$)", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n: at + n + 2] != CRLF:
            return None
        parts.append(body[at: at + n])
        at += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + CRLF + head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def address(url: str | None) -> str:
    return "about:blank" if url is None else re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def identifier(*parts: object) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.sha1('|'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def cut_at_characters(block: bytes, size: int) -> Iterator[bytes]:
    """Segments of at most ``size`` bytes that do not cut a character of UTF-8."""
    at = 0
    while at < len(block):
        end = min(at + size, len(block))
        while end < len(block) and end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        yield block[at:end]
        at = end


def page_records(key: object, url: str | None, payload: bytes, digest: str, kept: object, row: tuple, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page. ``kept``: key of the page that is stored for all with this payload, null if there is one only.

    A stored page that others refer to has an identifier made from its key and payload, any other page one made from its ``row``.
    """
    revisit = kept is not None and key != kept
    row = (key, digest) if kept is not None and not revisit else row
    own = identifier("record", *row)
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", address(url)),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if key is not None:
        fields.append((KEY_FIELD, str(key)))
    if revisit:
        yield record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      ("WARC-Refers-To", identifier("record", kept, digest)), ("Content-Type", "application/http; msgtype=response")], HTTP)
        return
    block = HTTP + framed(payload, chunk)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *fields, ("Content-Type", "application/http; msgtype=response")], block)
        return
    segments = list(cut_at_characters(block, segment))
    yield record([("WARC-Type", "response"), *fields, ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", "1")], segments[0])
    for n, part in enumerate(segments[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(segments) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", identifier("segment", n, *row)), ("WARC-Date", DATE),
                      ("WARC-Target-URI", address(url)), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Origin-ID", own), *last], part)


def write(pages: DataFrame, folder: str, html: str = "html", key: str = "page_id", url: str = "url", revisit_from: int = 1000, segment: int = SEGMENT,
          chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page (and its continuations) to gzipped archives in ``folder``."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # One narrow row for each digest that repeats; equal payloads are counted before the shuffle.
    again = rows.where(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(again.select("digest", "kept"), "digest", "left")
    # A null key never is the largest one; rows that share the largest are all stored.
    revisit = F.col("kept").isNotNull() & ~F.col("key").eqNullSafe(F.col("kept"))
    rows = rows.select("key", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "kept")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_key, page_url, text, digest, kept = r
                for rec in page_records(page_key, page_url, text.encode(), digest, kept, (page_key, digest, part, place), segment, chunk):
                    out.append(rec)
                    held += len(rec)
                place += 1
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], ["value"])

    total = pages.agg(F.sum(F.octet_length(html)), F.count("*")).first()
    per_file = max(1, int(total[1] * file_bytes / max(total[0] or 1, file_bytes)))
    archives = rows.mapInArrow(records, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    archives.option("maxRecordsPerFile", per_file).text(folder)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record."""
    at = 0
    while True:
        at = archive.find(VERSION[:5], at)
        if at < 0:
            return
        end = archive.find(CRLF + CRLF, at)
        if end < 0:
            return
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields.get("content-length", 0))
        yield fields, archive[end + 4: end + 4 + size]
        at = end + 4 + size


FIELDS = "id string, type string, uri string, digest string, refers string, row_key string, segment int, origin string, total bigint, block binary"
NAMES = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to", KEY_FIELD.lower(), "warc-segment-number",
         "warc-segment-origin-id", "warc-segment-total-length")


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives, as they are. A file, gzipped or not, is read as a whole by one task."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for raw in batch.column("content"):
                data = raw.as_py()
                while data[:2] == b"\x1f\x8b":                                 # one member or many
                    plain, rest = [], data
                    while rest:
                        unzip = zlib.decompressobj(31)
                        plain.append(unzip.decompress(rest))
                        rest = unzip.unused_data
                    data = b"".join(plain)
                out, held = [], 0
                for fields, block in parsed(data):
                    values = [fields.get(n) for n in NAMES]
                    values[6], values[8] = (None if v is None else int(v) for v in (values[6], values[8]))
                    out.append((*values, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield table(out)
                        out, held = [], 0
                if out:
                    yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 6 + [pa.int32(), pa.string(), pa.int64(), pa.binary()]
        names = [part.split()[0] for part in FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(parse, FIELDS)


def payload_of(block: Column) -> Column:
    """The payload of an HTTP response block, chunks decoded; null if the framing is broken."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if b is None else body(b) for b in batch.to_pylist()], pa.binary())

    def body(raw: bytes) -> bytes | None:
        head, mark, rest = raw.partition(CRLF + CRLF)
        if not mark:
            return None
        chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head)
        return unframed(rest) if chunked else rest

    return decode(block)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record: ``id``, ``type``, ``uri``, ``digest``, ``refers``, ``row_key``, ``payload``, ``complete``.

    ``refers`` is the identifier of the record that a revisit stands for.
    ``payload`` is null for revisits, and for a record with a missing segment, a wrong total length or broken chunks: ``complete`` is then
    false. ``digest`` is SHA-1 in lower-case hex, as the record states it.
    """
    found = raw_records(spark, folder)
    origin = F.coalesce("origin", "id")
    parts = found.where("segment is not null").withColumn("of", origin).groupBy("of").agg(
        # One record's segments. Repeated rows may share an identifier: their segments are equal.
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.count_if(F.col("segment") == 1).alias("copies"),
        *(F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "uri", "digest", "refers", "row_key")))
    # The pieces are joined as hexadecimal text, since arrays of binary have no concatenation of their own.
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    numbered = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = parts.select(F.col("of").alias("id"), "type", "uri", "digest", "refers", "row_key", whole.alias("block"), (numbered & F.col("total").isNotNull()).alias("ok"), "total",
                          F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    joined = joined.where("type is not null").withColumn("ok", F.col("ok") & (F.octet_length("block") == F.col("total"))).drop("total", "copy")
    single = found.where("segment is null and type in ('response', 'revisit')").select("id", "type", "uri", "digest", "refers", "row_key", "block", F.lit(True).alias("ok"))
    every = single.unionByName(joined)
    payload = payload_of(F.when((F.col("type") == "response") & F.col("ok"), F.col("block")))
    every = every.select("id", "type", "uri", hex_digest(F.col("digest")).alias("digest"), "refers", "row_key", payload.alias("payload"), "ok")
    return every.select("id", "type", "uri", "digest", "refers", "row_key", "payload", (F.col("ok") & ((F.col("type") == "revisit") | F.col("payload").isNotNull())).alias("complete"))


def hex_digest(labelled: Column) -> Column:
    """A ``sha1:`` digest in base 32 or hex as bare lower-case hex."""
    @F.arrow_udf("string")
    def plain(batch: pa.Array) -> pa.Array:
        return pa.array([None if v is None else bare(v.rpartition(":")[2]) for v in batch.to_pylist()], pa.string())

    def bare(value: str) -> str:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()

    return plain(labelled)
