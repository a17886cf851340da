"""The corpus pipeline: five stages over documents, each of one operator.

Each stage works on all that the one before kept; run() applies them to a folder's documents. Stages 1 to 4 return the
columns of documents, the last one token ids. The rows of a stage must be written before the next stage is called, as run()
does.

Defined results, for all stages: an empty table gives none; further columns, whatever their names, pass through stages 1 to 4.
Quality rules: null, empty and short texts go; a null language is one of its own; rows alike are judged alike. Near copies:
the least id stays, of equal ids the text of the least hash, of rows alike one; a row without an id goes if it has a copy with
one; texts without words stay. Repeated strings: a null text stays null, what repeats within one text is cut like
any other, and the rows stay though their texts may end up empty. Mixture: a null source is one like the others; documents without words may be
taken or not; rows alike are taken alike. Token ids: a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import bpe_prefix, mixing, ngram_join, quality_rules, suffix_dedup
from tideframe.llm.common import drop_written, left, remove, written

SHINGLE_WORDS, PERCENT = 5, 80
PASSAGE_WORDS = 51


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
WORKING: list[str] = []  # folders of the working tables of the stage before


def stage(function: Stage) -> Stage:
    """A stage whose working tables are removed when the next one is called: by then its rows must have been written."""

    @wraps(function)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        there = left(spark)
        remove(spark, [p for p in WORKING if p in there])
        WORKING.clear()
        before = set(left(spark))
        out = function(spark, docs, sf_dir)
        WORKING.extend(p for p in left(spark) if p not in before)
        return out

    return called


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays."""
    return ngram_join.first_of_each(docs, SHINGLE_WORDS, PERCENT)


@stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that repeat and passages of over 50 words that do are cut out of the texts."""
    out = suffix_dedup.clean_documents(docs, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard and shuffled within each."""
    return mixing.shuffled_documents(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and the hash of the text that they decode to."""
    named = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return bpe_prefix.round_trip(docs, **named).select("doc_id", "n_tokens", "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL can't express the joins, the induced sorting or the merges; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES[:-1]):
        before, docs = docs, written(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if i:
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
