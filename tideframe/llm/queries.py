"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_prefix, media_png, mixing, ngram_join, oracle_join, oracle_rules, pairwise_quality, quality_rules, suffix_dedup, token_files, toxicity, url_filters
from .common import held_out, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules that the URL query applies.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 9).alias("p_block"))


def op3_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    read = media_png.with_features(media_png.with_png(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, *toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pairwise_quality.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    scores = pairwise_quality.scored(docs, model)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= pairwise_quality.AT_CUTOFF).cast("int").alias("predicted"))


def op6_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.to_json("shards").alias("shards"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def op8_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    read = bpe_prefix.round_trip(table(spark, sf_dir, "documents"), **named)
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"), words=suffix_dedup.PASSAGE_WORDS).drop("removed")


#: Every query of this subpackage.
QUERIES = [op1_quality_rules, op2_url_filters, op3_media_png, op4_toxicity, op5_pairwise_quality, op6_mixing_tree, op7_ngram_join, op8_bpe_prefix, op9_token_files, op10_suffix_dedup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL where whole tables are cheap enough for it; the others are tested against brute force."""
    return {"op1_quality_rules": oracle_rules.op1_sql(), "op7_ngram_join": oracle_join.op7_sql()}
