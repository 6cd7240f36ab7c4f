"""Registered queries of the text operators, each over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tenderglow.llm import (
    byte_bpe, collocations, debruijn, decontaminate, embedding_pairs, lm_score, near_dup, oracles, pii, prefix_trie, quality_pu, quality_rules, secret_scan, toxicity,
)
from tenderglow.llm.common import documents
from tenderglow.session import scratch_path

RANKS = "byte_bpe_50k.tiktoken"

# The other queries have columns that are learned, or spans of checksum and context rules; tests follow them by hand.
SQL = {"op5_debruijn": oracles.REPEATS, "op7_near_dup": oracles.COMPONENTS, "op10_decontaminate": oracles.OVERLAPS,
       "op11_collocations": oracles.PHRASES, "op12_prefix_trie": oracles.TRIE, "op13_embedding_pairs": oracles.VECTOR_LINKS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    if fn.__name__ in SQL:
        ORACLES[fn.__name__] = SQL[fn.__name__].strip()
    return fn


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir))


@query
def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.digest(quality_pu.score_quality(documents(spark, sf_dir), _labels(spark, sf_dir)))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(documents(spark, sf_dir)))


@query
def op5_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(documents(spark, sf_dir))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digest(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(near_dup.find_components(documents(spark, sf_dir)))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.apply_rules(documents(spark, sf_dir), _labels(spark, sf_dir)))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two versions of the table: an earlier one with half of the documents, then the whole one, which scans the rest.
    whole = documents(spark, sf_dir)
    earlier = whole.where(F.col("doc_id") % 2 == 0)
    return secret_scan.digest(secret_scan.load_in_turn([earlier, whole], scratch_path(spark, "ledger")))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.find_overlaps(documents(spark, sf_dir), benchmark))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pairs.digest(embedding_pairs.find_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
