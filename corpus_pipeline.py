"""A corpus pipeline: each stage works on all rows that its predecessor kept.

language ID -> SimHash near-dedup -> benchmark decontamination -> mixing -> sharding. Every stage is
a function (spark, docs, sf_dir) that returns a DataFrame, written as Parquet and read again as the
next stage's docs; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from waymark.llm.common import scratch, shared_dir
from waymark.llm.queries import domain_labels, table, target_shares


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null and letterless texts are rejected."""
    model = language_id.train(docs)
    return language_id.predict(docs, model).where("lang_pred != 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture draws at least once."""
    return mixing.mixed(docs, domain_labels(spark, sf_dir), target_shares(spark), keep="high")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.assign(docs).drop("linked")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", remove_benchmark),
    ("mix", mix_sources),
    ("shard", shard),
]

#: SQL cannot express these stages; tests/llm tests them one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/waymark/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
