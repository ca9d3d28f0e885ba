"""Staged clean-up of a corpus: every stage reads what its predecessor stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

from gleanery.llm import mixing, pieces, simhash, substrings, toxicity
from gleanery.llm.common import bounded_row_groups, table
from gleanery.session import ensure_checkpoint_dir

CHECKS: dict[str, Observation] = {}   # counts of rows and of failed checks by stage, once its result is stored


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.one_per_group(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has go; the documents stay."""
    return substrings.cleaned(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources, some twice; a shard is one large file."""
    bounded_row_groups(spark)
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, each encoded by two libraries and decoded again."""
    bounded_row_groups(spark)
    CHECKS["sentencepiece"] = seen = Observation()
    return pieces.tokenized(docs, seen=seen)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_array_substrings", repeated_substrings),
    ("source_mix", source_mix),
    ("sentencepiece", encoding),
]

ORACLE_SQL = None  # classifier, tokenizer and random draws are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
