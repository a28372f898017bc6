"""The corpus pipeline: language identification, near-duplicate removal,
benchmark decontamination, mixing to target weights, token output.

Each stage reads what its predecessor wrote, works on all of it, and returns
the columns of ``documents`` (the last one: one row per document written, as
read back from the token files).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontamination, language_id, mixing, ngram_join, token_output
from ledgerlens.llm.common import crc_bucket, table
from ledgerlens.session import scratch_root

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letter, null text) go."""
    model = language_id.train(docs.filter(crc_bucket("doc_id", 3) != 1))
    return language_id.drop_unknown(docs, model, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles the smallest id stays."""
    return ngram_join.drop_near_copies(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.apply_mix(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and what they hold per document."""
    path = token_output.corpus_path(spark, "pipeline")
    token_output.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

# Trained models, hashing and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
