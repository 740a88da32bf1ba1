"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

language    documents that are in no learned language go
copies      of documents that are near-duplicates (fingerprints that differ in at most four bits, as in op2, or a
            similarity of five-word shingles of 0.8 or more), the one with the smallest id stays
secrets     secrets in the texts are replaced
mixture     sources are drawn to tempered weights; a document of a small source may come twice, one of a large source
            may be left out
tokens      every text as token ids

All stages but the last return the columns of ``documents``.  Null texts, empty tables, ties, repeated rows and further
columns are treated as the operators' docstrings say: a null or empty text has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, common, language, minhash, mixing, secrets, simhash
from tablewright.llm.components import components
from tablewright.session import scratch_path

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
MAX_REPEATS = 1.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return language.keep_identified(docs, language.train(docs))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Both kinds of links lead on from one document to the next, so their components are joined before any document goes."""
    common.small_batches(spark)
    found = [near(docs).where("doc_id <> component_id").select(
        F.col("doc_id").cast("bigint").alias("u"), F.col("component_id").alias("v"))
        for near in (simhash.near_duplicates, minhash.near_duplicates)]
    links = common.stored(found[0].union(found[1]).distinct(), "near")
    gone = common.stored(components(links).where("node <> component").select(F.col("node").alias("__gone")), "gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["__gone"], "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    encoded = bpe.encode(docs, common.tokenizer_path(RANK_FILE), decoded=True)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language_stage), ("copies", copies_stage), ("secrets", secrets_stage),
          ("mixture", mixture_stage), ("tokens", tokens_stage)]
# Hash orders, SimHash and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
