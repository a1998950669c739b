"""Named pipelines: from landed files and extracted units and cells to tables, copies and catalog rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import ROUTES, content_hash, extension, route, table_name
from tidewater.operators.assemble import cell_counters, deck_text, document_text, typed_tables, unit_counters
from tidewater.operators.clean import clean_frame
from tidewater.operators.infer import cast_typed, profile
from tidewater.operators.merge import dedup_exact, latest, upsert_documents
from tidewater.sources.files import images, landing, plain_csv, structured
from tidewater.sources.writers import load_simple, replace_table, write_parquet


def structured_file(spark: SparkSession, path: str, table: str, base: str) -> DataFrame:
    """A landed object, of a type, delimiter and encoding found by content, to a typed table and a Parquet copy; returns the
    table. An empty one is an error."""
    raw = structured(spark, path)
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")
    replace_table(cast_typed(clean_frame(raw)), table, f"{base}/table")
    write_parquet(spark.table(table), f"{base}/copy")
    return spark.table(table)


def structured_row(spark: SparkSession, path: str, loaded: DataFrame, object_name: str) -> DataFrame:
    """The catalog row of a landed object that was loaded: its size, and a profile of its table as metadata."""
    size = landing(spark, path).agg(F.sum("length").alias("object_size"))
    facts = profile(loaded)
    metadata = F.to_json(F.struct("row_count", "column_count", F.split("columns", ",").alias("columns"), F.from_json("data_types", "map<string,string>").alias("data_types")))
    return facts.crossJoin(size).select(F.lit("lake").alias("bucket_name"), F.lit(object_name).alias("object_name"), "object_size", extension(F.lit(object_name)).alias("file_format"), F.col("row_count").cast("int").alias("row_count"), F.lit(False).alias("text_extracted"), metadata.alias("metadata"))


def sample_load(spark: SparkSession, csv_path: str, table: str, base: str) -> DataFrame:
    """A CSV file with simple types to a table and a Parquet copy; returns the copy."""
    load_simple(plain_csv(spark, csv_path), table, f"{base}/table")
    return spark.read.parquet(write_parquet(spark.table(table), f"{base}/copy"))


def documents(docs: DataFrame, units: DataFrame, slides: bool = False) -> DataFrame:
    """doc_no, text, n_units, n_chars, canonical_object, is_duplicate of each document with units: text is put together
    for first copies only. docs: id, object_name, text_content."""
    firsts = dedup_exact(docs).select(F.col("id").alias("doc_no"), "object_name", "canonical_object", "is_duplicate")
    needed = units.join(firsts.filter(~F.col("is_duplicate")).select("doc_no"), "doc_no", "left_semi")
    text = (deck_text if slides else document_text)(needed)
    counts = unit_counters(needed).select("doc_no", "n_units", "n_chars")
    rows = firsts.join(units.select("doc_no").distinct(), "doc_no", "left_semi")
    return rows.join(text, "doc_no", "left").join(counts, "doc_no", "left").select("doc_no", "object_name", "canonical_object", "is_duplicate", "text", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), (F.length("text") > 0).alias("text_extracted"))


def loaded_documents(current: DataFrame, made: DataFrame, now: str) -> DataFrame:
    """The documents table after documents that have text: one row a content; of several objects with it, the last by name."""
    texts = made.filter(F.length("text") > 0).select("object_name", extension(F.col("object_name")).alias("file_type"), F.col("text").alias("text_content"), content_hash(F.col("text")).alias("content_hash"), F.lit(now).cast("timestamp_ntz").alias("created_at"))
    return upsert_documents(current, latest(texts, ["content_hash"], ["object_name"]))


def document_tables(cells: DataFrame, first_suffix: int = 1) -> DataFrame:
    """Types of all columns of all extracted tables, with the size of each table."""
    return typed_tables(cells, first_suffix).join(cell_counters(cells).select("table_no", "n_rows"), "table_no")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    return images(spark, folder)


def routed(catalog: DataFrame) -> DataFrame:
    """Each object's route and the table it would load; names that several objects share are counted."""
    ext = extension(F.col("object_name"))
    named = catalog.select("catalog_id", "object_name", route(ext).alias("route"), table_name(F.col("object_name")).alias("table_name"))
    shared = named.groupBy("table_name").agg(F.countDistinct("object_name").alias("objects"))
    return named.join(shared, "table_name").select("catalog_id", "route", "table_name", "objects")


def dispatch(files: DataFrame, pipelines: Mapping[str, Callable[[DataFrame], object]]) -> dict[str, object]:
    """Run each route's pipeline over the files (object_name, ...) of that route, if there are any; what each returns.

    Files without a route, or of one that has no pipeline given, are left."""
    named = files.withColumn("route", route(extension(F.col("object_name"))))
    there = {r["route"] for r in named.select("route").distinct().collect()}
    return {name: run(named.filter(F.col("route") == name).drop("route")) for name, run in pipelines.items() if name in there}


def dispatched(catalog: DataFrame) -> dict[str, DataFrame]:
    """The objects of each route, one frame each, for the pipeline of that route; unsupported ones are among none of them."""
    named = catalog.withColumn("route", route(extension(F.col("object_name"))))
    return {name: named.filter(F.col("route") == name) for name in sorted(set(ROUTES.values()))}
