"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog import Catalog
from codeloom.llm import bpe, decontaminate, hard_negatives, jaccard_join, language_id, lexical, oracles, packing, quality, sharding, substring_dedup, token_counts, url_filter, warc
from codeloom.llm.common import scratch, stored

catalog = Catalog()

# Production parameters.
SHARDS = [f"shard-{i:03d}" for i in range(128)]
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@catalog.add("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and cuts are look-ups in the prefix table of every text; the tables themselves are not part of the result."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary, TOKEN_LIMIT, keep_prefixes=True)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


@catalog.add("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    prototypes = language_id.learn(docs.where(~out))
    return language_id.predict(docs, prototypes).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@catalog.add("op3_warc", oracles.WARC)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as folder:
        warc.write_archives(table(spark, sf_dir, "pages"), folder + "/archives")
        return stored(warc.read_digests(spark, folder + "/archives"))


@catalog.add("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@catalog.add("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


@catalog.add("op6_decontaminate", oracles.DECONTAMINATE)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@catalog.add("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@catalog.add("op8_jaccard_join", oracles.JACCARD)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


@catalog.add("op9_substring_dedup", oracles.SUBSTRINGS)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@catalog.add("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "valid_utf8",
    )


@catalog.add("op11_hard_negatives", oracles.HARD_NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives at most for each of five positives of every hundredth row; every seventh row has the next label."""
    number = F.col("vec_id")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table(spark, sf_dir, "embeddings").select(
        number.alias("id"),
        F.when(number % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.when(finite(x), F.floor(256 * x.cast("double")).cast("bigint"))).alias("vector"),
    )
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


@catalog.add("op12_lexical_search", oracles.LEXICAL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every test item; nulls have no terms."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@catalog.add("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most ``TOKEN_LIMIT`` ids; a null text is empty."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)
