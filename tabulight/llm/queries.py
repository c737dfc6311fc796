"""The operators on the test tables, each over its whole table, and the SQL for those that have one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulight.llm import alignment, divergence, embedding_dedup, fingerprints, language, licenses, mixing, passages, pieces, quality, simhash, token_files, warc
from tabulight.llm.storage import kept, new_folder

END_ID = 2
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_ids(ids: Column) -> Column:
    """CRC-32 (unsigned) of ids as little-endian 32-bit integers."""
    @F.arrow_udf("bigint")
    def crc(batch: pa.Array) -> pa.Array:
        offsets, raw = np.asarray(batch.offsets), memoryview(np.asarray(batch.values).astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())

    return crc(ids)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    back = token_files.read(spark, folder)
    return back.select("doc_id", "start", F.size("ids").cast("bigint").alias("n_tokens"), crc32_of_ids(F.col("ids")).alias("ids_crc32"))


def op2_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
           least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
    FROM embeddings"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.concat_ws(",", c).alias(c) for c in ("sentences", "line_sentences", "licenses")))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edits(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text("fingerprint"),
                        text("edited_fingerprint"), "near_edited", "near_next")


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = table(spark, sf_dir, "documents").select("doc_id", pieces.encode_and_decode(F.col("text"), model).alias("found"))
    ids = F.col("found.ids")
    return found.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), ids_sha256(ids).alias("ids_sha256"),
                        F.sha2(F.col("found.text").cast("binary"), 256).alias("decoded_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    warc.write(pages, folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = warc.read(spark, folder)
    narrow = kept(found.select("id", "type", "refers", F.col("row_key").cast(kind).alias("page_id"), F.octet_length("payload").cast("bigint").alias("bytes"),
                               F.coalesce(F.sha1("payload"), "digest").alias("payload_digest")))
    stored = narrow.where("type = 'response'").groupBy(F.col("id").alias("refers")).agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("full"))
    return narrow.join(stored, "refers", "left").select(
        "page_id", F.coalesce("bytes", "full").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP8_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
                 max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM s"""


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = language.identify(F.col("text"), model)
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, (size, source_size, target, rate, copies) = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"),
                        (F.col(copies) * F.col(size)).alias("taken"), F.col(rate).alias("rate"), F.col(copies).alias("copies"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    vocab AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    size AS (SELECT lang, count(*)::HUGEINT AS v FROM vocab GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN vocab USING (lang, term) GROUP BY lang, source, term),
    own AS (SELECT g.lang, g.source, t.term, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
            FROM groups g JOIN vocab t USING (lang) JOIN size USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = t.term),
    p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total::HUGEINT + 2 * v) AS p FROM own),
    whole AS (SELECT lang, term, sum(n)::HUGEINT AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, any_value(v) AS v FROM own GROUP BY lang, term),
    q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (total::HUGEINT + 2 * v) AS q FROM whole),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
    hit AS (SELECT doc_id, i FROM w WHERE words IN (SELECT words FROM w GROUP BY words HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM hit),
    per AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
    kept AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
                    coalesce(list_transform(list_filter(range(1, len(ws) + 1), lambda x: js IS NULL OR NOT list_contains(js, x)), lambda x: ws[x]), []) AS ks FROM d LEFT JOIN per USING (doc_id))
    SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    found = alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_token_files, op2_embedding_near_duplicates, op3_license_scan, op4_document_fingerprints, op5_sentencepiece, op6_quality_classifier,
    op7_simhash_near_duplicates, op8_warc_archives, op9_language_id, op10_source_mix, op11_source_divergence,
    op12_repeated_passages, op13_token_alignment)}
ORACLES: dict[str, str] = {"op2_embedding_near_duplicates": OP2_SQL, "op3_license_scan": licenses.scan_sql(), "op8_warc_archives": OP8_SQL, "op11_source_divergence": OP11_SQL,
                            "op12_repeated_passages": OP12_SQL}
