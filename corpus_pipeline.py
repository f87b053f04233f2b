"""A corpus pipeline of four stages; each works on all that its predecessor kept.

All but the last return the columns of their input, whatever further columns it has and however they are called, and
an empty table for an empty one. Null and empty texts have no language and go with the first stage; null ids, sources
and languages pass; rows that repeat an id and a text are copies of each other like any others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.llm import bpe, jaccard, mixing
from pagetally.llm.common import kept, small_batches, staged, tidied
from pagetally.llm.entries import identified

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what language identification rejects goes."""
    held = docs.select("doc_id", "text", "lang", "source", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    found = identified(held).filter("accepted").select("doc.*")
    with small_batches(spark):
        return staged(found, "accepted")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word n-grams, Jaccard similarity of 0.8 or more. The one with
    the smallest id stays; texts without words are copies of nothing."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents as often as the mix takes them, the last one of a source cut
    to the words that its target leaves (lang and source stay, n_chars is counted anew)."""
    quality = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mix = mixing.mixed(docs, mixing.mix_documents(docs, quality))
    return mix.withColumn("n_chars", F.length("text").cast("bigint"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text's bytes; a row per document that came in."""
    codec = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.round_trip_documents(docs, codec)
    rows = rows.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", bpe.ids_digest(F.col("ids")).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))
    with small_batches(spark):
        return staged(rows, "encoded")


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents. A stage's intermediate tables go once its result is written; the results stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tidied(spark):
            docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
