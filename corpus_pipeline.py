"""From raw documents to packed sequences: language, quality, near duplicates, personal data, packing.

Each stage reads all rows that the one before it kept and returns the columns of `documents`; the last
returns pieces of packed sequences. Nulls in any column, repeated rows and repeated ids pass through; a row
with a null text or without a letter is rejected as of unknown language. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.llm import hamming_join, language_id, packing, repetition, semi_crf
from linefold.llm.common import bucket_of, written

#: A document whose most likely language is less likely than this is rejected.
LEAST_SCORE = 0.5

ORACLE_SQL = None


def _only(judged: DataFrame, docs: DataFrame, condition: str) -> DataFrame:
    return judged.where(condition).select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; a quarter of the labelled rows stays out of the training."""
    model = language_id.train(docs, bucket_of("doc_id", 4) != 2)
    judged = language_id.identify(docs, model)
    return _only(judged, docs, f"lang_pred <> '{language_id.UNKNOWN}' and score >= {LEAST_SCORE}")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(repetition.judge(docs), docs, "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Where ids are missing or repeated, rows are numbered and the first of a group stays.
    """
    unclear = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if unclear.isEmpty():
        key, keyed = "doc_id", docs
    else:
        key = "row"
        while key in docs.columns:
            key += "_"
        keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    clusters = hamming_join.cluster(keyed, key=key, width=5, percent=80)
    kept = clusters.where("kept").select(F.col("doc_id").alias(key))
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become `<kind>`; n_chars follows the text."""
    clean = semi_crf.redact(docs, semi_crf.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
