"""A corpus pipeline: quality filter, exact and near dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe import encode_documents, vocabulary
from sparkloom.llm.common import materialize, table
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.quality import quality_filter
from sparkloom.llm.simhash import near_dedup_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest id stays."""
    return near_dedup_rows(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stayed, encoded: doc_id, lang and source go with the ids."""
    return encode_documents(docs, *vocabulary(), keep=("lang", "source"), with_bytes=False)


#: Name and function of each stage; a stage's result is written as Parquet and read again as the next one's docs.
STAGES = [("quality", quality), ("exact", exact), ("near", near), ("clean", clean), ("tokens", tokens)]

#: The classifier and the fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
