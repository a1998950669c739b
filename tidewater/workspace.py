"""Where the library writes what it reads again: the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 200_000


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (dots as double underscores) for what is planned or started inside; then as they were."""
    names = {k.replace("__", "."): str(x) for k, x in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, x in names.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


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
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: what is derived from it sees the same rows each time."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `rows` rows; counting stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A table of many small Parquet files. Spark would list each folder by a task of its own and read a few files by another, and keep
    what it knows of all these tasks on the driver; here some tasks do it."""
    tasks = spark.sparkContext.defaultParallelism * 4
    with settings(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=tasks):
        return spark.read.options(**options).parquet(path).coalesce(tasks)
