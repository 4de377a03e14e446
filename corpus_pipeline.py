"""From raw documents to token ids: five stages, each reading what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.llm import bpe, mixing, ngram_join, pii, quality_rules
from pendscope.llm.common import shared_folder, short_batches, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    short_batches(spark)
    return quality_rules.kept_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    short_batches(spark)
    return ngram_join.one_of_each(docs)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms."""
    short_batches(spark)
    return pii.pseudonymised_documents(docs, pii.stored_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of the sources ask."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the place of the text."""
    short_batches(spark)
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", hide_persons),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]
ORACLE_SQL = None  # pseudonyms and byte-pair merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for step, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{step}")
        docs = spark.read.parquet(f"{folder}/{step}")
    return docs
