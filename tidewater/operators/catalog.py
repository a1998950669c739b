"""Questions about the catalog of files: scoping, filters, listing, totals and trends.

Nulls: a null owner is seen by admins only; null formats are left out where the question is about formats. Order is stated with
the place of nulls and a tie-break. "Today" is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import ACCEPTED, basename, category, extension, gigabytes, kilobytes, megabytes, preview, route

LISTED = ["catalog_id", "bucket_name", "object_name", "object_size", "file_format", "row_count", "text_extracted", "uploaded_by", "created_at", "metadata"]
TEXT_FORMATS = ("pdf", "docx", "pptx")


def scoped(catalog: DataFrame, user_id: int | None = None, role: str = "admin") -> DataFrame:
    """Rows that the user may see: all for an admin, else their own."""
    return catalog if role == "admin" else catalog.filter(F.col("uploaded_by") == user_id)


def conjunction(predicates: list[Column | None]) -> Column:
    """All predicates that are given; true if none is."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def with_format(fmt: str | None) -> Column | None:
    return None if not fmt else F.col("file_format") == fmt


def containing(column: str, text: str | None) -> Column | None:
    """Case-insensitive substring; % and _ in the text stay wildcards."""
    return None if not text else F.ilike(F.col(column), F.lit(f"%{text}%"))


def created_on(day: str) -> Column:
    return F.to_date("created_at") == F.lit(day).cast("date")


def created_since(day: str, days: int = 30) -> Column:
    return F.col("created_at") >= F.date_sub(F.lit(day).cast("date"), days)


def listing(catalog: DataFrame) -> DataFrame:
    return catalog.select(*LISTED)


def display(catalog: DataFrame) -> DataFrame:
    """As a list shows it: base name, kilobytes with a decimal, defaults for format and owner."""
    return catalog.select("catalog_id", basename(F.col("object_name")).alias("name"), kilobytes(F.col("object_size"), 1).alias("size_kb"), F.coalesce("file_format", F.lit("unknown")).alias("format"), F.coalesce(F.col("uploaded_by").cast("string"), F.lit("system")).alias("owner"))


def classify(catalog: DataFrame) -> DataFrame:
    """Extension, category, route and whether the file is accepted."""
    ext = extension(F.col("object_name"))
    return catalog.select("catalog_id", ext.alias("ext"), category(ext).alias("category"), route(ext).alias("route"), ext.isin(*ACCEPTED).alias("accepted"))


def storage_by_format(catalog: DataFrame) -> DataFrame:
    """Files, bytes and mean size of each format, largest total first."""
    sums = catalog.filter(F.col("file_format").isNotNull()).groupBy("file_format").agg(F.count(F.lit(1)).alias("file_count"), F.sum("object_size").alias("total_size"), F.avg("object_size").alias("avg_size"))
    sized = sums.withColumns({"total_size_mb": F.coalesce(megabytes(F.col("total_size")), F.lit(0.0)), "avg_size_kb": F.coalesce(kilobytes(F.col("avg_size")), F.lit(0.0))})
    return sized.orderBy(F.desc_nulls_first("total_size"), "file_format")


def formats_count(catalog: DataFrame) -> DataFrame:
    """Files of each format, most first."""
    return catalog.filter(F.col("file_format").isNotNull()).groupBy("file_format").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "file_format")


def dashboard_metrics(catalog: DataFrame, as_of: str) -> DataFrame:
    """Files in all, created on the day and under raw/, and gigabytes: one row from one pass."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(created_on(as_of)).alias("today_files"),
        F.count_if(F.col("object_name").startswith("raw/")).alias("raw_files"),
        gigabytes(F.coalesce(F.sum("object_size"), F.lit(0))).alias("total_gb"),
    )


def daily_trend(catalog: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Files of each day and format over the trailing days, newest first."""
    recent = catalog.filter(created_since(as_of, days)).groupBy(F.to_date("created_at").alias("date"), "file_format").agg(F.count(F.lit(1)).alias("count"))
    return recent.orderBy(F.desc("date"), F.asc_nulls_last("file_format"))


def extraction_rate(catalog: DataFrame) -> DataFrame:
    """Text documents, how many gave text, and the percentage (0 if there are none)."""
    sums = catalog.filter(F.col("file_format").isin(*TEXT_FORMATS)).agg(F.count(F.lit(1)).alias("total"), F.count_if("text_extracted").alias("extracted"))
    return sums.withColumn("rate", F.when(F.col("total") > 0, F.bround(100.0 * F.col("extracted") / F.col("total"), 2)).otherwise(0.0))


def matching(catalog: DataFrame, fmt: str | None = None, search: str | None = None) -> DataFrame:
    return catalog.filter(conjunction([with_format(fmt), containing("object_name", search)]))


def files_page(catalog: DataFrame, limit: int = 50, offset: int = 0, fmt: str | None = None, search: str | None = None) -> DataFrame:
    """A page of the listing, newest first."""
    return listing(matching(catalog, fmt, search)).orderBy(F.desc_nulls_first("created_at"), F.desc("catalog_id")).offset(offset).limit(limit)


def files_after(catalog: DataFrame, limit: int = 50, last: tuple | None = None, fmt: str | None = None, search: str | None = None) -> DataFrame:
    """The page of the listing that follows the row `last` (its created_at and catalog_id), the first page without one: the same order
    as files_page, but rows before it are filtered out and not sorted, however far the page is."""
    rows = listing(matching(catalog, fmt, search))
    if last is not None:
        created, number = last
        same = F.col("created_at").eqNullSafe(F.lit(created).cast("timestamp_ntz")) & (F.col("catalog_id") < number)
        rows = rows.filter(same | (F.col("created_at").isNotNull() if created is None else F.col("created_at") < F.lit(created).cast("timestamp_ntz")))
    return rows.orderBy(F.desc_nulls_first("created_at"), F.desc("catalog_id")).limit(limit)


def recent_activity(catalog: DataFrame, n: int = 5) -> DataFrame:
    return catalog.select("catalog_id", "object_name", "file_format", "created_at").orderBy(F.desc_nulls_first("created_at"), F.desc("catalog_id")).limit(n)


def search_docs(docs: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Documents whose text contains the query, newest (largest id) first, with a preview."""
    found = docs.filter(containing("text_content", query)).select("id", "object_name", "file_type", preview(F.col("text_content")).alias("preview"))
    return found if limit is None else found.orderBy(F.desc("id")).limit(limit)
