"""The numbered queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.llm import (
    conversation_repair,
    hamming_join,
    hash_forest,
    kd_search,
    language_id,
    packing,
    periodic_runs,
    repetition,
    semi_crf,
    string_kernel,
    suffix_tree,
    token_files,
    tree_bpe,
)
from linefold.llm.common import bucket_of, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BPE_50K = "byte_bpe_50k.json"
BPE_MULTI = "byte_bpe_multi_50k.tiktoken"


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_tree.score(docs.withColumn("held", bucket_of("doc_id", 5) == 1), "held")


@query
def op2_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.cluster(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", bucket_of("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = string_kernel.train(docs.where("not held_out").join(labels, "doc_id"))
    return string_kernel.judge(docs, model).drop("text")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(BPE_50K), end_id=2, capacity=1024)


@query
def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hash_forest.search(vectors, F.col("vec_id") % 50 == 0, k=5)


@query
def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = token_files.write(docs, scratch(spark, "tokens"), public_tokenizers.path(BPE_50K), end_id=0)
    return token_files.read_digests(spark, files)


@query
def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tree_bpe.round_trip(docs, public_tokenizers.path(BPE_MULTI), public_tokenizers.PATTERN).drop("text")


@query
def op9_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return semi_crf.mark(docs, semi_crf.train(docs)).drop("text")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", bucket_of("doc_id", 4) == 2)
    model = language_id.train(docs, ~F.col("held_out"))
    return language_id.identify(docs.drop("lang"), model).drop("text")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(talks), talks)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.judge(periodic_runs.planted(docs)).drop("text")


@query
def op13_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kd_search.search(vectors, F.col("vec_id") % 20 == 0, k=20)


ORACLES["op13_kd_search"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
