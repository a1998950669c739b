"""Keyed upserts, deletes, exact duplicates and lookups between files, catalog and owners.

Plain Parquet has no MERGE, so an upsert reads the current table and the changes and returns the next version of the table. Of a
stored table, which is partitioned by the hash of its key, only the partitions that changes fall into are read, joined and
written anew. Keys are never null in the result: changes with a null key are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import content_hash
from tidewater.workspace import maybe_broadcast, saved


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key by `order`, the later columns breaking ties."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return changes.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], overwrite: list[str], keep: list[str] = (), prefer_new: list[str] = (), touched: str | None = None, now: str | None = None) -> DataFrame:
    """current with changes (one row for each key): columns in `overwrite` take the new value, those in `prefer_new` only where
    it is not null, `keep` and all others stay. New keys are inserted. `touched` gets `now` on rows that were updated."""
    changes = changes.dropna(subset=keys)
    c, n = current.withColumn("_c", F.lit(True)), changes.withColumn("_n", F.lit(True))
    joined = c.alias("c").join(n.alias("n"), keys, "full_outer")
    both, fresh = F.col("_c").isNotNull() & F.col("_n").isNotNull(), F.col("_c").isNull()
    out = []
    for name in current.columns:
        if name in keys:
            out.append(F.col(name))
            continue
        old = F.col(f"c.{name}")
        new = F.col(f"n.{name}") if name in changes.columns else F.lit(None)
        if name == touched:
            value = F.when(both, F.lit(now).cast("timestamp_ntz")).when(fresh, new).otherwise(old)
        elif name in prefer_new:
            value = F.coalesce(new, old)
        elif name in overwrite:
            value = F.when(F.col("_n").isNotNull(), new).otherwise(old)
        else:
            value = F.when(fresh, new).otherwise(old)
        out.append(value.cast(current.schema[name].dataType).alias(name))
    return joined.select(*out)


#: Partitions of a stored table. A table keeps the number that it was made with.
PARTS = 64


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with its column `part`; without rows if nothing is stored yet."""
    whole = f"{schema}, part int"
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def upsert_stored(spark: SparkSession, path: str, schema: str, keys: list[str], changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Apply changes (one row for each key) to a stored table; the partitions that were written anew, of which the driver gets the numbers.

    change(current, changes) gives the next rows of those partitions. Doing it again gives the same rows."""
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = saved(changes.dropna(subset=keys).withColumn("part", part), "changes")
    touched = sorted(r["part"] for r in new.select("part").distinct().collect())
    if touched:
        current = stored(spark, path, schema).filter(F.col("part").isin(touched)).drop("part")
        rows = change(current, new.drop("part")).withColumn("part", part)
        # brought together by partition, but a very large one is written by several tasks
        rows.hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return touched


CATALOG_KEYS = ["bucket_name", "object_name"]
CATALOG_OVERWRITE = ["object_size", "file_format", "row_count", "text_extracted", "content_hash", "metadata"]


def upsert_catalog(current: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Owners stay where the change has none; ids and creation times stay."""
    return upsert(current, changes, CATALOG_KEYS, CATALOG_OVERWRITE, prefer_new=["uploaded_by"], touched="last_modified", now=now)


def touch_catalog(current: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Only size, metadata and the time of change."""
    return upsert(current, changes, CATALOG_KEYS, ["object_size", "metadata"], touched="last_modified", now=now)


def upsert_documents(current: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(current, changes, ["content_hash"], ["object_name", "file_type", "text_content", "created_at"])


def delete_rows(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(maybe_broadcast(ids.select(key).distinct()), key, "left_anti")


def with_column_default(df: DataFrame, name: str, default: object) -> DataFrame:
    """df with the column, added with a default where it is missing."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def assign_ids(rows: DataFrame, order: list[str], first: int = 1, name: str = "id") -> DataFrame:
    """Consecutive ids for new rows in the order given: rows are ranged, numbered in each range and written once, then offset by
    the ranges before, so no task numbers all of them. Ties in the order may come in any order."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = saved(ranged, "numbered").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside + F.lit(first)).drop("_part", "_at", "_before")


def with_content_hash(df: DataFrame, column: str = "text_content") -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col(column)))


def dedup_exact(docs: DataFrame, key: str = "object_name") -> DataFrame:
    """content_hash, canonical_object (the first by name), is_duplicate for every row. The first objects are written before they
    are joined, so that Spark can split the rows of a hot text."""
    hashed = with_content_hash(docs).select("id", key, "content_hash")
    first = saved(hashed.groupBy("content_hash").agg(F.min(key).alias("canonical_object")), "first")
    return hashed.join(first, "content_hash").withColumn("is_duplicate", F.col(key) != F.col("canonical_object"))


def _of_others(files: DataFrame, catalog: DataFrame, how: str) -> DataFrame:
    """Files joined to the contents that other objects of the catalog have: a content's first and last object tell, so it is one row."""
    known = catalog.filter(F.col("content_hash").isNotNull()).groupBy(F.col("content_hash").alias("_h")).agg(F.min("object_name").alias("_least"), F.max("object_name").alias("_most"))
    return files.join(saved(known, "known"), (F.col("content_hash") == F.col("_h")) & ((F.col("object_name") != F.col("_least")) | (F.col("object_name") != F.col("_most"))), how)


def new_only(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose content no other object of the catalog has. A file's own earlier row does not count."""
    return _of_others(files, catalog, "left_anti")


def seen_only(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return _of_others(files, catalog, "left_semi")


def reconcile(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalog rows with what the store says of their object: whether it is there, and its size."""
    there = stored.groupBy("object_name").agg(F.max("length").alias("stored_size"))
    return catalog.select("catalog_id", "object_name", "object_size").join(there, "object_name", "left").withColumn("exists", F.col("stored_size").isNotNull())


def resolve_owner(catalog: DataFrame, users: DataFrame) -> DataFrame:
    """catalog_id, uploaded_by, username; owners that are gone become null."""
    known = users.select(F.col("id").alias("_user"), "username")
    joined = catalog.join(maybe_broadcast(known), F.col("uploaded_by") == F.col("_user"), "left")
    return joined.select("catalog_id", F.col("_user").cast("int").alias("uploaded_by"), "username")
