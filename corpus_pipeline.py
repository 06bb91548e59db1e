"""The corpus pipeline: reject poor documents, keep one of each near-duplicate group, mask personal data, pack the rest.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns
of ``documents``. Nulls, empty tables and repeated rows go by the rules in the operators' docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import packing, pii, quality, simhash
from graphloom.llm.common import written

#: No SQL: the stages hash, learn and tokenise. tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


#: Rows of an Arrow batch, at most, in the pipeline's session: texts may be long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1024


def bounded(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above; it learns from the labels of the documents given."""
    bounded(spark)
    return quality.keep_documents(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each near-duplicate group."""
    bounded(spark)
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets and its n_chars counted anew."""
    bounded(spark)
    masked = pii.mask_documents(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of at most 2048 tokens."""
    bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", reject_poor), ("near_duplicates", keep_one_of_each), ("personal_data", mask_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
