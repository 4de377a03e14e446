"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pendscope.llm import (
    bpe, chat_format, chat_repair, fingerprints, hard_negatives, license_scan, mixing, ngram_join, pii, quality_rules, secrets, toxicity,
    url_filter,
)
from pendscope.llm.common import short_batches, table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(short_batches(spark), sf_dir, name))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(short_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_pseudonyms(table(short_batches(spark), sf_dir, "documents"), pii.stored_key(spark))


QUERIES = {
    "op1_license_scan": _over("documents", license_scan.license_scan),
    "op2_source_mix": _over("documents", mixing.source_mix),
    "op3_quality_rules": _over("documents", quality_rules.quality_rules),
    "op4_pii_pseudonyms": _pseudonyms,
    "op5_url_filter": _over("pages", url_filter.url_filter),
    "op6_fingerprints": _over("documents", fingerprints.document_fingerprints),
    "op7_ngram_jaccard": _over("documents", ngram_join.ngram_jaccard),
    "op8_bpe": _over("documents", bpe.encode_digests),
    "op9_toxicity": _toxicity,
    "op10_secrets": _over("documents", secrets.secret_scan),
    "op11_chat_repair": _over("conversations", chat_repair.repair_digests),
    "op12_chat_format": _over("conversations", chat_format.chat_digests),
    "op13_hard_negatives": _over("embeddings", hard_negatives.hard_negatives),
}
