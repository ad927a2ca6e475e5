"""The corpus pipeline: each stage reads its predecessor's rows from Parquet and returns the rows it keeps.

Language ID drops documents in which no language is found; near-dedup keeps one document of each class; decontamination
drops documents that hold benchmark passages by the contract's rule; mixing takes and repeats documents towards the
source targets; the last stage turns them into fixed-stride token records in training order.

An empty table runs through to no records; other columns than those of ``documents`` pass through the filtering stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontam, langid, mixing, orderminhash, tokens
from llm.common import checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    learned = langid.learn(docs, F.lit(True))
    kept = langid.classify(docs.select(*columns), learned)
    return kept.where(F.col("lang_pred") != langid.UNKNOWN).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return orderminhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.in_training_order(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_records", token_records),
]

#: A learned model and keyed draws decide which rows stay, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}-{name}")
            docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
