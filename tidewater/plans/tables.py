"""Schemas of the fixed tables, and the tables created where they are absent."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CATALOG = "catalog_id long, bucket_name string, object_name string, object_size long, file_format string, row_count int, text_extracted boolean, content_hash string, last_modified timestamp_ntz, created_at timestamp_ntz, uploaded_by int, metadata string"
DOCUMENTS = "id long, object_name string, file_type string, text_content string, content_hash string, created_at timestamp_ntz"
IMAGES = "id long, object_name string, img_format string, width int, height int, ocr_text string, content_hash string, created_at timestamp_ntz"
USERS = "id int, username string, role string, created_at timestamp_ntz"


def create_if_absent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one is written first if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)


def required(df: DataFrame) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError("no rows")
    return df
