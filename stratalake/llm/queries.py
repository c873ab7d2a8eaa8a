"""The operators' registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, html_text, licenses, mixing, near_dedup, personal_data, quality, token_counts, url_filter
from .tables import load


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"), url_filter.entries(spark))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detect(load(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(load(spark, sf_dir, "documents"), threshold=85)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree of sources and ids; see licenses.sharded_dir."""
    documents = load(spark, sf_dir, "documents")
    return licenses.scan(documents.select("doc_id", licenses.sharded_dir(documents.doc_id, documents.source).alias("dir"), "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return quality.quality_scores(documents, quality.train(documents, load(spark, sf_dir, "labels")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(load(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_decontaminate, op4_personal_data, op5_near_dedup, op6_licenses, op7_quality_classifier, op8_mix_sources, op9_fingerprints, op10_html_text)}
ORACLE: dict[str, str] = {"op1_url_filter": url_filter.ORACLE_SQL}
