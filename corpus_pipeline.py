"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  The quality stage drops what the classifier rejects, the near-duplicate stage keeps the document
of least id of each group, the benchmark stage drops contaminated documents, the personal-data stage
masks spans in the texts, and the mix keeps what it takes at least once, with the number of its copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import decontaminate, mixing, near_dedup, personal_data, quality
from stratalake.llm.tables import load, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs, threshold=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.mask(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=True).filter("copies > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("personal_data", personal_data_stage),
    ("mix", mix_stage),
]

#: No SQL: compression, hashes and EM can't be expressed in it; tests/llm/test_pipeline.py holds the rows against plain forms of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read from there."""
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
