"""The given tables as catalog, documents, units, cells and dirty columns. One text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30"

CATALOG = [
    "event_id AS catalog_id",
    "'lake' AS bucket_name",
    "concat(CASE WHEN event_id % 3 = 0 THEN 'processed/structured/' ELSE 'raw/' END, event_type, '/', 'File ', CAST(event_id % 7000 AS VARCHAR(20)), '.', CASE event_type WHEN 'click' THEN 'csv' WHEN 'view' THEN 'PDF' WHEN 'purchase' THEN 'docx' WHEN 'signup' THEN 'pptx' ELSE 'bin' END) AS object_name",
    "CAST(round(value * 100) AS BIGINT) AS object_size",
    "CASE event_type WHEN 'click' THEN 'csv' WHEN 'view' THEN 'pdf' WHEN 'purchase' THEN 'docx' WHEN 'signup' THEN 'pptx' END AS file_format",
    "CAST(event_id % 100 AS INT) AS row_count",
    "(event_id % 4 <> 0) AS text_extracted",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS INT) END AS uploaded_by",
    "ts AS created_at",
    "props AS metadata",
]
DOCS = ["doc_id AS id", "concat('raw/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt') AS object_name", "lang AS file_type", "text AS text_content"]
UNITS = ["conv_id AS doc_no", "turn AS pos", "CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'body' ELSE 'notes' END AS kind", "text"]
_DIRTY = {
    "int_col": "CAST(o_orderkey AS VARCHAR(20))",
    "big_col": "CAST(o_orderkey + 3000000000 AS VARCHAR(20))",
    "num_col": "CASE WHEN o_orderkey % 11 = 0 THEN ' N/A ' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20)) END",
    "date_col": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20))",
    "bool_col": "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "json_col": "concat('{\"p\": \"', o_orderpriority, '\"}')",
    "text_col": "CASE WHEN o_orderkey % 13 = 0 THEN 'NULL' ELSE concat('  ', o_orderstatus, ' ') END",
}
DIRTY = [*(f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {e} END AS {c}" for c, e in _DIRTY.items()), "CAST(NULL AS VARCHAR(20)) AS empty_col"]
USERS = ["CAST(c_custkey AS INT) AS id", "c_name AS username"]

CELLS_SQL = """SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS table_no, CAST(0 AS BIGINT) AS row_no, c.col_no, c.header AS text FROM part CROSS JOIN (VALUES (0,'Part Key'),(1,'Name!'),(2,'Name!'),(3,'')) AS c(col_no, header)
UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey % 50 + 1, 0, CAST(p_partkey AS VARCHAR(20)) FROM part
UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey % 50 + 1, 1, concat(' ', p_name, ' ') FROM part
UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey % 50 + 1, 2, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END FROM part
UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey % 50 + 1, 3, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR(20)) END FROM part WHERE p_partkey % 4 <> 0"""

#: DuckDB definitions of the views.
SQL = {
    "catalog_v": f"SELECT {', '.join(CATALOG)} FROM events",
    "docs_v": f"SELECT {', '.join(DOCS)} FROM documents",
    "units_v": f"SELECT {', '.join(UNITS)} FROM conversations",
    "dirty_v": f"SELECT {', '.join(DIRTY)} FROM orders",
    "users_v": f"SELECT {', '.join(USERS)} FROM customer WHERE c_custkey % 10 <> 0",
    "cells_v": CELLS_SQL,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*CATALOG)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*DOCS)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*UNITS)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*DIRTY)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, some gone."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").selectExpr(*USERS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    number = F.floor(F.col("p_partkey") / 50).cast("bigint").alias("table_no")
    names = F.array(*(F.struct(F.lit(i).alias("col_no"), F.lit(t).alias("text")) for i, t in enumerate(("Part Key", "Name!", "Name!", ""))))
    top = part.select(number).distinct().select("table_no", F.lit(0).cast("bigint").alias("row_no"), F.inline(names))
    row = (F.col("p_partkey") % 50 + 1).alias("row_no")
    size = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string"))
    values = [F.col("p_partkey").cast("string"), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")), size]
    data = part.select(number, row, F.inline(F.array(*(F.struct(F.lit(i).alias("col_no"), v.alias("text")) for i, v in enumerate(values)))), "p_partkey")
    return top.unionByName(data.filter((F.col("col_no") < 3) | (F.col("p_partkey") % 4 != 0)).drop("p_partkey"))
