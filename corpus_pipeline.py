"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import shared_dir, written
from tidewright.llm.mixing import mixed_documents
from tidewright.llm.near_dedup import one_of_each
from tidewright.llm.packing import packed
from tidewright.llm.pii import pii_masked
from tidewright.llm.queries import word_tokenizer
from tidewright.llm.quality_rules import kept_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii_masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packed(docs, word_tokenizer())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", mask_pii), ("mix", mix), ("pack", pack)]

#: Signatures, vocabularies and packing have no SQL; tests/llm/test_pipeline.py compares every stage, and the whole, with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, beginning with the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
