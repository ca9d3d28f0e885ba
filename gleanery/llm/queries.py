"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import blocks, collisions, licenses, maintext, mixing, negatives, phrases, pieces, simhash, substrings, topk, toxicity, warc
from gleanery.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, sf_dir)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.report(table(spark, sf_dir, "embeddings"))


def op10_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.report(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.report(spark, sf_dir)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_topk": op2_topk,
    "op3_suffix_array": op3_suffix_array,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_pieces": op7_pieces,
    "op8_mixing": op8_mixing,
    "op9_collisions": op9_collisions,
    "op10_blocks": op10_blocks,
    "op11_negatives": op11_negatives,
    "op12_phrases": op12_phrases,
    "op13_maintext": op13_maintext,
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_topk": topk.SQL,
    "op3_suffix_array": substrings.SQL,
    "op4_licenses": licenses.sql(),
    "op9_collisions": collisions.SQL,
    "op10_blocks": blocks.SQL,
    "op11_negatives": negatives.SQL,
    "op12_phrases": phrases.SQL,
}
