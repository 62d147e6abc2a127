"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark contamination, mixing to weights, binary token ids.

Every stage is a function of (spark, docs, sf_dir) and works on all that the one before kept; `run` writes each result as
Parquet into the shared folder, hands the next stage what it reads back, and removes it once that is written.

Defined results: nulls, empty texts, repeated rows and empty tables are as each stage's operator states; columns of any name are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm.decontaminate import drop_contaminated
from readloom.llm.mixing import mix_documents
from readloom.llm.neardup import drop_near_duplicates
from readloom.llm.tokens import token_rows
from readloom.llm.toxicity import drop_toxic
from readloom.session import drop_written, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_rows(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: No SQL can express a trained classifier, near-duplicate links or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return docs
