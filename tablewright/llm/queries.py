"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (bpe, common, embeddings, language, mixing, packing, quality, repeats, secrets, sharding,
                             simhash, spelling, tokens, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = shipped
    return fn


BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(common.documents(spark, sf_dir), common.tokenizer_path(BYTE_BPE))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir)).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(common.documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(common.documents(spark, sf_dir))


def bpe_digests(docs: DataFrame) -> DataFrame:
    encoded = bpe.encode(docs, common.tokenizer_path(BYTE_BPE), decoded=True)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.documents(spark, sf_dir)).select(
        "doc_id", *[f"n_{kind}" for kind in secrets.BASE], F.sha2(secrets.as_text("base"), 256).alias("base_sha256"),
        secrets.as_text("found").alias("spans"))


@query
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def held_out():
    """A quarter of the documents teaches nothing."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def identified(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    return language.predict(docs, language.train(learn_from.where(~held_out())))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identified(docs, docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "fit")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return mixing.mix(docs, max_repeats=2.0).select("doc_id", "source", "epoch", "block", "block_order", "within")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.documents(spark, sf_dir))


ORACLES["op10_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
eight AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' '
                 || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS k
          FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM eight WHERE k IS NOT NULL) AS x WHERE c > 1),
gaps AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8), 8) AS own FROM twice),
repeats AS (SELECT doc_id, sum(own) AS n FROM gaps GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(lines) AS line FROM w),
l AS (SELECT doc_id, source, t, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM raw),
often AS (SELECT source AS host, line AS own FROM l GROUP BY source, line HAVING count(DISTINCT t) > 20),
removed AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM l JOIN often ON line = own AND source IS NOT DISTINCT FROM host GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_lines,
             CAST(coalesce(removed.chars, 0) AS BIGINT) AS removed_chars
      FROM w LEFT JOIN repeats ON repeats.doc_id = w.doc_id LEFT JOIN removed ON removed.doc_id = w.doc_id),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             removed_chars > 0 AND (word_chars - removed_chars < CAST(0.3 AS DOUBLE) * word_chars OR word_chars - removed_chars < 60) AS depleted FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, removed_chars,
       NOT base_failed AND NOT depleted AS kept FROM g"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(common.documents(spark, sf_dir), at_least=5, slip=199), times=5)


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), common.tokenizer_path("word_bpe_49k.json"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
