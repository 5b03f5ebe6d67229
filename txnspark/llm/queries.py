"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark.llm import (chat, classifier, exact_dedup, mixing, packing, pii, prefix_trie,
                          quality_rules, sharding, simhash, token_shards, toxicity,
                          vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@query
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents"))


@query
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op3_source_mix"] = mixing.ORACLE


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.quality_verdicts(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "d2")


@query
def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
                        "component_id")


@query
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"))
    return chat.read_back(*chat.prefix_tree(given.union(extra)))


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.quality_scores(_table(spark, folder, "documents"),
                                     _table(spark, folder, "labels"))


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                  AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op9_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return token_shards.write_shards(_table(spark, folder, "documents"))[0]


@query
def op10_uniform_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.uniform_shards(_table(spark, folder, "documents"))


@query
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_report(_table(spark, folder, "embeddings"))


ORACLES["op12_vector_codes"] = vector_codes.oracle()


@query
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"),
                                    _table(spark, folder, "labels"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations")).drop("prefix_hash")
