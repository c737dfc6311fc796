"""From raw documents to token ids: quality, language, near duplicates, mixture, encoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulight.llm import language, mixing, near_copies, pieces, quality
from tabulight.llm.storage import new_folder, remove_folder


#: What goes to Python at a time. Whole texts in batches of Spark's 10,000 rows or 64 MB lie in memory several times, beside the executor and in it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def in_small_batches(stage: Callable) -> Callable:
    """The stage with ``BATCH`` set in its session; results do not depend on it."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling against the texts labelled good."""
    return quality.drawn_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which letters or words are known; only those without letters, or of unknown ones, go, not those between languages."""
    return language.confident_only(docs, language.learn(docs))


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return near_copies.one_of_each_group(docs)


@in_small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.repeated(docs)


@in_small_batches
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and a digest of the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = docs.select("doc_id", "lang", "source", pieces.encode_and_decode(F.col("text"), model).alias("found"))
    return found.select("doc_id", "lang", "source", F.size("found.ids").cast("bigint").alias("n_tokens"), F.col("found.ids").alias("ids"),
                        F.sha2(F.col("found.text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]
#: The stages use models and hashes that SQL cannot express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what the next one has read is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = new_folder(spark, "pipeline-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return docs
