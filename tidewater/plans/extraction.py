"""From extracted documents to everything that is kept of them: text and JSON objects, tables, documents and catalog rows.

What parsers take out of PDF, Word and slide files comes as units (text in order) and cells. Of files with one content only the first
is processed; later ones, here or after earlier runs, get a catalog row without rows and text. Each step writes under
fixed keys or upserts by key, so a run that failed can be made again as a whole.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.images import with_image_header
from tidewater.functions.text import metadata, stem, table_name, trimmed
from tidewater.operators.assemble import column_types, csv_texts, data_cells, deck_text, document_text, page_text, slides, table_key, unit_counters
from tidewater.operators.infer import as_type
from tidewater.operators.merge import CATALOG_KEYS, PARTS, stored, upsert, upsert_catalog, upsert_documents, upsert_stored
from tidewater.plans.tables import CATALOG, DOCUMENTS, IMAGES
from tidewater.sources.writers import put_decks, put_tables, put_texts
from tidewater.workspace import saved, small_files

#: Jobs that load tables at the same time.
LOADERS = 8


@dataclass(frozen=True)
class Lake:
    """Where things are kept: objects under `base`, typed tables under `tables`, stored tables at the other paths."""

    base: str
    tables: str
    catalog: str
    documents: str
    images: str
    parts: int = PARTS


def first_copies(files: DataFrame, known: DataFrame) -> DataFrame:
    """files with is_duplicate: another object brought the content before, in `known` (content_hash, object_name) or, by name, among the files."""
    firsts = saved(files.groupBy("content_hash").agg(F.min("object_name").alias("_first")), "first")
    earlier = saved(known.groupBy("content_hash").agg(F.min("object_name").alias("_least"), F.max("object_name").alias("_most")), "earlier")
    other = (F.col("_least") != F.col("object_name")) | (F.col("_most") != F.col("object_name"))
    joined = files.join(firsts, "content_hash").join(earlier, "content_hash", "left")
    return joined.withColumn("is_duplicate", F.coalesce(other, F.lit(False)) | (F.col("_first") != F.col("object_name"))).drop("_first", "_least", "_most")


def catalog_changes(rows: DataFrame, now: str, **values: Column) -> DataFrame:
    """Rows (object_name, and the columns given) as rows of the catalog; what is not given is null."""
    given = {"bucket_name": F.lit("lake"), "object_name": F.col("object_name"), "created_at": F.lit(now).cast("timestamp_ntz"), **values}
    kinds = [x.strip().split(" ") for x in CATALOG.split(",")]
    return rows.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds))


def _upserted(spark: SparkSession, lake: Lake, rows: DataFrame, now: str) -> None:
    upsert_stored(spark, lake.catalog, CATALOG, CATALOG_KEYS, rows, lambda current, new: upsert_catalog(current, new, now), lake.parts)


def load_tables(data: DataFrame, types: DataFrame, base: str) -> DataFrame:
    """Typed tables from long data cells: those of one schema are written by one job, a folder each. Returns table_no, signature, path.

    The driver gets the distinct schemas, not the tables."""
    columns = F.array_sort(F.collect_list(F.struct("col_no", "col_name", "inferred_type", "decimal", "formats")))
    listed = types.groupBy("table_no").agg(columns.alias("c")).withColumn("columns", F.transform("c", lambda x: F.struct(x["col_name"].alias("name"), x["inferred_type"].alias("kind"), F.when(x["inferred_type"] == "NUMERIC", x["decimal"]).alias("decimal"), F.when(x["inferred_type"] == "TIMESTAMP", x["formats"]).otherwise(0).alias("formats"))))
    named = saved(listed.select("table_no", "columns", F.md5(F.to_json("columns")).alias("signature")), "schemas")
    rows = data.groupBy("table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "value"))), lambda x: x["value"]).alias("values"))
    spark = data.sparkSession
    path = f"{base}/.rows"
    rows.join(named.select("table_no", "signature"), "table_no").write.mode("overwrite").partitionBy("signature").parquet(path)

    def load(schema) -> None:
        mine = spark.read.parquet(path).filter(F.col("signature") == schema["signature"])
        cast = [F.expr(as_type(f"values[{i}]", c["kind"], c["decimal"], c["formats"])).alias(c["name"]) for i, c in enumerate(schema["columns"])]
        # brought together by table, but a very large one is written by several tasks
        mine.select("table_no", *cast).hint("rebalance", F.col("table_no")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_no").parquet(f"{base}/{schema['signature']}")

    schemas = named.groupBy("signature").agg(F.min("columns").alias("columns")).collect()
    with ThreadPoolExecutor(LOADERS) as pool:
        list(pool.map(load, schemas))
    return named.select("table_no", "signature", F.concat(F.lit(f"{base}/"), "signature", F.lit("/table_no="), F.col("table_no").cast("string")).alias("path"))


def loaded_tables(spark: SparkSession, base: str, signature: str) -> DataFrame:
    """All typed tables of one schema, with table_no."""
    return small_files(spark, f"{base}/{signature}")


def documents(spark: SparkSession, kind: str, files: DataFrame, units: DataFrame, cells: DataFrame, tables: DataFrame, lake: Lake, now: str, facts: dict[str, Column] | None = None) -> DataFrame:
    """Process the documents of a kind (pdf, docx, pptx).

    files: doc_no, object_name, object_size, content_hash. units: doc_no, pos, kind, text. cells: table_no, row_no, col_no, text. tables: table_no,
    doc_no, place (page or slide, from 1), nth. facts: further fields of the documents' metadata, from columns of files. Returns table_no, table_key, table_name, n_rows, signature, path of the tables loaded.
    """
    told = saved(first_copies(files, stored(spark, lake.documents, DOCUMENTS).select("content_hash", "object_name")), "told")
    firsts = told.filter("NOT is_duplicate")
    mine = units.join(firsts.select("doc_no"), "doc_no", "left_semi")
    texts = {"pdf": page_text, "docx": document_text, "pptx": deck_text}[kind](mine)
    made = saved(firsts.join(texts, "doc_no").filter(trimmed(F.col("text")) != ""), "texts")
    put_texts(made, lake.base)
    rows = made.select(F.lit(None).cast("long").alias("id"), "object_name", F.lit(kind).alias("file_type"), F.col("text").alias("text_content"), "content_hash", F.lit(now).cast("timestamp_ntz").alias("created_at"))
    upsert_stored(spark, lake.documents, DOCUMENTS, ["content_hash"], rows, upsert_documents, lake.parts)
    if kind == "pptx":
        put_decks(slides(mine).join(firsts.select("doc_no", "object_name"), "doc_no"), lake.base)

    theirs = tables.join(firsts.select("doc_no", "object_name"), "doc_no")
    keyed = saved(theirs.select("table_no", "doc_no", table_key(kind, stem(F.col("object_name")), F.col("place"), F.col("nth")).alias("table_key")), "keys")
    data = saved(data_cells(cells.join(keyed.select("table_no"), "table_no", "left_semi"), 2 if kind == "docx" else 1), "data")
    csv = saved(csv_texts(data).join(keyed, "table_no"), "csv")
    put_tables(csv, lake.base)
    loaded = load_tables(data, column_types(data), lake.tables)
    of_tables = catalog_changes(csv.withColumn("object_name", F.col("table_key")), now, object_size=F.octet_length("content"), file_format=F.lit("csv"), row_count=F.col("n_rows"), text_extracted=F.lit(False))

    counts = csv.groupBy("doc_no").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_table_rows"))
    parts = unit_counters(mine).select("doc_no", "n_units")
    known = told.join(made.select("doc_no", F.lit(True).alias("said")), "doc_no", "left").join(counts, "doc_no", "left").join(parts, "doc_no", "left")
    whole = F.col("is_duplicate")
    n_tables = F.coalesce("n_tables", F.lit(0))
    n_rows = F.coalesce("n_table_rows", F.lit(0)) if kind == "docx" else n_tables
    own = {"pdf": "page_count", "docx": "paragraph_count", "pptx": "slide_count"}[kind]
    described = metadata({"pptx": "ppt"}.get(kind, kind), **{own: F.coalesce("n_units", F.lit(0)), "table_count": n_tables, **(facts or {})})
    of_files = catalog_changes(known, now, object_size=F.col("object_size"), file_format=F.lit(kind), row_count=F.when(whole, 0).otherwise(n_rows), text_extracted=~whole & F.coalesce("said", F.lit(False)), content_hash=F.col("content_hash"), metadata=F.when(~whole, described))
    _upserted(spark, lake, of_tables.unionByName(of_files), now)
    return csv.select("table_no", "table_key", table_name(F.col("table_key")).alias("table_name"), "n_rows").join(loaded, "table_no")


def images(spark: SparkSession, files: DataFrame, lake: Lake, now: str) -> None:
    """Process image files (object_name, content): size and format from their headers, kept by content; files that are no images are left out.

    Headers of first copies alone are read. Recognised text comes from elsewhere; none is set here."""
    hashed = files.select("object_name", F.octet_length("content").cast("long").alias("object_size"), F.sha2("content", 256).alias("content_hash"), "content")
    known = stored(spark, lake.images, IMAGES).select("content_hash", "object_name")
    told = saved(first_copies(hashed.drop("content"), known), "told")
    firsts = hashed.select("object_name", "content").join(told.filter("NOT is_duplicate").select("object_name"), "object_name", "left_semi")
    read = saved(with_image_header(firsts).drop("content").filter(F.col("img_format").isNotNull()), "headers")
    made = told.filter("NOT is_duplicate").join(read, "object_name")
    rows = made.select(F.lit(None).cast("long").alias("id"), "object_name", "img_format", "width", "height", F.lit(None).cast("string").alias("ocr_text"), "content_hash", F.lit(now).cast("timestamp_ntz").alias("created_at"))
    upsert_stored(spark, lake.images, IMAGES, ["content_hash"], rows, lambda current, new: upsert(current, new, ["content_hash"], ["object_name", "img_format", "width", "height", "ocr_text"]), lake.parts)
    described = metadata("image", width=F.col("width"), height=F.col("height"), format=F.col("img_format"), mode=F.col("mode"), exif=F.create_map().cast("map<string,string>"))
    fresh = catalog_changes(made, now, object_size=F.col("object_size"), file_format=F.lit("image"), text_extracted=F.lit(False), content_hash=F.col("content_hash"), metadata=described)
    copies = catalog_changes(told.filter("is_duplicate"), now, object_size=F.col("object_size"), file_format=F.lit("image"), row_count=F.lit(0), text_extracted=F.lit(False), content_hash=F.col("content_hash"))
    _upserted(spark, lake, fresh.unionByName(copies), now)
