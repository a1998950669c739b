"""A training corpus from `documents`: each stage is written as Parquet and read again as the next one's documents.

Rows with null or empty texts are scored, linked with nothing, never contaminated, and stay; they become an end id alone. Rows
with a null doc_id stay in all stages. Rows that share a doc_id are one document: they go or stay together. Null langs and
sources are values like any other. Texts are whole at any length. Other columns, whatever their names, are carried on to the last
stage, which returns its own. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import new_path, read
from tidewater.llm.decontaminate import decontaminated
from tidewater.llm.mixing import mixed
from tidewater.llm.near_dup import without_near_duplicates
from tidewater.llm.queries import tokenizer_path
from tidewater.llm.token_output import token_digest
from tidewater.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold."""
    return without_toxic(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots: files, and rows in them, ascend."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order of the rows of docs' files, or of doc_id if docs were not read from files."""
    try:
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
        ordered = docs.select("doc_id", "text", number.alias("file_number"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    except AnalysisException:
        return token_digest(docs, tokenizer_path())
    return token_digest(ordered, tokenizer_path(), keys=("file_number", "file_name", "row_index"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: The first stage scores by a fitted model and the last one runs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = new_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
