"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart.llm import bpe, quality_rules, secret_scan, simhash, source_mix
from tillmart.operators.shared_storage import new_folder

ORACLE_SQL = None  # fingerprints and merges are beyond SQL; tests compare every stage with brute force
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
POSITION = "training_position"


def passing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source has its share of words: documents come as often as they are taken, each copy with its position."""
    return source_mix.in_training_order(docs, position=POSITION)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``training_position``, ``n_tokens`` and ``tokens`` of every copy of the mix; the training
    order is by position, then id."""
    tokens = bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN,
                        keep=("doc_id", "source", POSITION))
    return tokens.withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES = [("quality_rules", passing), ("simhash_near_dedup", distinct), ("secret_scan", without_secrets),
          ("source_mix", mixed), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
