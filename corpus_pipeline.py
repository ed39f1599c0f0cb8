"""A training corpus from raw documents: five stages, each written and read again.

Quality rules, exact dedup, near-dedup, mixing, encoding. Stages but the last
return rows of `documents` with its columns; the last returns each row's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: the documents that pass the rules."""
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: one document of each text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: one document of each group of near copies."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: each document as many times as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: doc_id, n_tokens and digests of ids and decoded text, a row for each row of the mix."""
    return sentencepiece_codec.digests(docs, sentencepiece_codec.model_path())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are written to the shared folder first, and go when the next one's are there."""
    docs = common.documents(spark, sf_dir)
    scratch = common.Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        written = scratch.cut(out)
        common.release(out)
        if n:
            scratch.drop(docs)
        docs = written
    return scratch.result(STAGES[-1][1](spark, docs, sf_dir))


#: The isolation forest and the near copies can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None
