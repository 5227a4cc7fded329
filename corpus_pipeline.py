"""From raw documents to token ids: each stage takes all that the stage before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog import Catalog
from codeloom.llm import bpe, decontaminate, jaccard_join, language_id, substring_dedup
from codeloom.session import shared_folder

# Near-copies: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters, or like none of them, go."""
    return language_id.keep_known(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near-copies, that of the smallest id."""
    return jaccard_join.drop_similar(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that one of smaller id has too."""
    return substring_dedup.cut_repeats(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a test item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the digest of what they decode to."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", distinct_documents),
    ("substring_dedup", distinct_passages),
    ("decontaminate", clean_of_benchmark),
    ("bpe", token_ids),
]

# Language prototypes and byte-pair merges are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None

catalog = Catalog()


@catalog.add("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
