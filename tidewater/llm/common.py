"""What the training-data operators share: the shared folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when no more rows of it, and no more bytes in its strings, were counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of rows that Spark hands to a Python worker at once; a row that is longer goes alone.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs on one machine, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and losing an executor loses none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if df has no more than `rows` rows, and its strings no more than `size` bytes; counting stops at the row bound."""
    strings = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if f.dataType.simpleString() == "string"]
    found = df.select(sum(strings, F.lit(0).cast("long")).alias("size")).limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return found["rows"] <= rows and found["size"] <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else df for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


#: Parts that the rows of a key are dealt to where one key may hold very many.
SALTS = 64


def salted(rows: DataFrame, value: str) -> DataFrame:
    """rows with _salt, from the hash of a column: a key's rows are dealt to SALTS parts."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))


def least_by_part(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, _salt, `name` (the key's least value), size (the key's rows): a row for each part that a key has rows in.

    Rows that are salted by `value` are joined to it by keys and _salt, so no task gets all rows of a key.
    """
    parts = saved(salted(rows, value).groupBy(*keys, "_salt").agg(F.min(value).alias("_least"), F.count(F.lit(1)).alias("_rows")), "parts")
    whole = parts.groupBy(*keys).agg(F.min("_least").alias(name), F.sum("_rows").alias("size"))
    return parts.select(*keys, "_salt").join(whole, keys)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over the batches of a partition, after which the worker, which Spark keeps for other tasks, gives back the memory it has freed."""

    def over(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return over


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose session from here on hands rows to Python in batches of BATCH_BYTES, or as it was told (fewer bytes, or a number with a unit).

    Spark's own bound is 10,000 rows or 64 MB, which both the executor and the worker hold, whatever the worker then
    takes from them at a time. The setting stays: Spark reads it when the result is asked for.
    """
    conf = df.sparkSession.conf
    told = re.fullmatch(r"(\d+)b?", conf.get(BATCH_SETTING))
    if told and int(told[1]) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
