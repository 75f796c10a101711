"""From raw documents to tokens: classify, deduplicate, mix, encode. Every stage writes its rows before the next one reads them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import bpe, jaccard, mixing, quality, toxicity
from eventlens.llm.common import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not call toxic."""
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word runs, Jaccard likeness 0.8 or more."""
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the number of tokens, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Trained models, components and draws are not to be had in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
