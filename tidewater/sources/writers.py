"""Sinks: Parquet copies, replaced tables, CSV objects of tables, text objects, and the archive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import stem
from tidewater.operators.clean import complex_to_json
from tidewater.operators.infer import cast_typed, simple_typed
from tidewater.sources.objects import put_objects


def write_parquet(df: DataFrame, path: str) -> str:
    """Snappy Parquet; structs, arrays and maps as JSON text."""
    complex_to_json(df).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def replace_table(df: DataFrame, name: str, path: str) -> str:
    """A table in place of any of that name: its files go to a new folder below path, and the name points there only once they are
    all written and can be read. A load that fails leaves the old table as it was; files that no name points to may stay."""
    spark = df.sparkSession
    place = f"{path}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    spark.read.schema(df.schema).parquet(place).isEmpty()
    if spark.catalog.tableExists(name):
        kept = spark.table(name).schema
        if [(f.name, f.dataType) for f in kept] == [(f.name, f.dataType) for f in df.schema]:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
            spark.catalog.refreshTable(name)
            return name
        # another schema: an external table's files outlive its name
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path=place, source="parquet", schema=df.schema)
    return name


def load_typed(df: DataFrame, name: str, path: str) -> str:
    return replace_table(cast_typed(df), name, path)


def load_text(df: DataFrame, name: str, path: str) -> str:
    return replace_table(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)), name, path)


def load_simple(df: DataFrame, name: str, path: str) -> str:
    return replace_table(simple_typed(df), name, path)


#: Where texts and slides of processed documents are kept.
TEXTS, DECKS = "processed/unstructured/text-extracted/", "processed/unstructured/ppt-structured/"


def put_texts(docs: DataFrame, base: str) -> str:
    """The text of each document (object_name, text) as an object named after its file."""
    return put_objects(docs.select(F.concat(F.lit(TEXTS), stem(F.col("object_name")), F.lit(".txt")).alias("key"), F.col("text").alias("content")), base)


def put_decks(decks: DataFrame, base: str) -> str:
    """Slides (object_name, title, body, notes) as a JSON object for each file."""
    return put_objects(decks.select(F.concat(F.lit(DECKS), stem(F.col("object_name")), F.lit(".json")).alias("key"), F.to_json(F.struct("title", "body", "notes")).alias("content")), base)


def put_tables(tables: DataFrame, base: str) -> str:
    """CSV texts (table_key, content) as objects."""
    return put_objects(tables.select(F.col("table_key").alias("key"), "content"), base)


def archive(objects: DataFrame, base: str, day: str) -> str:
    """A copy of each object (key, content) under the day of ingest, at its own key: doing it again adds nothing."""
    return put_objects(objects.select(F.concat(F.lit(f"{day}/"), "key").alias("key"), "content"), base)
