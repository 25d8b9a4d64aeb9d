"""Corpus pipeline: toxicity, quality rules, near-duplicates, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last keep the columns of documents.

Defined results: documents without any word fail the quality rules; null texts too; extra columns stay;
an empty table stays empty through all stages.

Whole texts go to Python in Arrow batches of at most ``common.BATCH_ROWS`` rows: the stages set that for the session, unless it asks
for fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridewell.llm import host_rules, minhash_dedup, packing, secrets, toxicity
from stridewell.llm.common import short_batches, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; learnt from the table of labels."""
    short_batches(spark)
    return toxicity.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host is not refused."""
    return host_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates (runs of five words, 0.8)."""
    short_batches(spark)
    return minhash_dedup.keep_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    short_batches(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a training sequence."""
    short_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity is a fitted model: SQL cannot express the pipeline.
ORACLE_SQL = None
