"""Objects: one file a row, under the key that the row gives.

A Python data source stages what each task writes in a folder of its own; when all tasks are done, its commit lists the folders that
count, and a second job moves their files to their keys, each by a rename. A task that fails and is tried again leaves nothing
but a folder that is not listed; a write that fails as a whole removes what it staged and moves nothing. Moving what has
been moved changes nothing. An object replaces an earlier one of its key; of rows with one key in one write, one stays.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewater.workspace import saved

MANIFEST = "committed.txt"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path)


def checked_key(key: str | None) -> str:
    """A key that stays below its base, or an error."""
    if not key or key.startswith("/") or key.endswith("/") or any(p in ("", ".", "..") for p in key.split("/")):
        raise ValueError(f"not a key of an object: {key!r}")
    return key


def _put(system: fs.FileSystem, path: str, content: bytes, made: set[str]) -> None:
    folder = posixpath.dirname(path)
    if folder not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)
    with system.open_output_stream(path) as out:
        out.write(content)


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        context = TaskContext.get()
        folder = f"{context.partitionId()}-{context.taskAttemptId()}"
        system, base = store(self.path)
        made: set[str] = set()
        for batch in iterator:
            for key, content in zip(batch.column("key"), batch.column("content"), strict=True):
                _put(system, f"{base}/{folder}/{checked_key(key.as_py())}", content.as_py() or b"", made)
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = store(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write("".join(f"{m.folder}\n" for m in messages if m is not None).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        system, base = store(self.path)
        if system.get_file_info(base).type != fs.FileType.NotFound:
            system.delete_dir(base)


class ObjectSource(DataSource):
    """The format `staged_objects`: rows of key and content, staged under `path`."""

    @classmethod
    def name(cls) -> str:
        return "staged_objects"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"])


def stage_objects(objects: DataFrame, path: str) -> str:
    """Rows (key, content) as files under path, with the list of folders that count."""
    objects.sparkSession.dataSource.register(ObjectSource)
    content = F.col("content") if dict(objects.dtypes)["content"] == "binary" else F.encode(F.col("content"), "UTF-8")
    objects.select(F.col("key").cast("string"), content.alias("content")).write.format(ObjectSource.name()).mode("append").option("path", path).save()
    return path


def publish(spark: SparkSession, staged: str, base: str) -> int:
    """Move staged objects to their keys under base; how many there were. Each task moves the objects of some staged folders."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, source = store(staged)
        _, target = store(base)
        made: set[str] = set()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                top = f"{source}/{name}"
                moved = 0
                for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                    if info.type == fs.FileType.File:
                        path = f"{target}/{info.path[info.path.index(top) + len(top) + 1 :]}"
                        if posixpath.dirname(path) not in made:
                            system.create_dir(posixpath.dirname(path), recursive=True)
                            made.add(posixpath.dirname(path))
                        system.move(info.path, path)
                        moved += 1
                yield pa.record_batch([pa.array([moved], pa.int64())], names=["moved"])

    folders = spark.read.text(f"{staged}/{MANIFEST}")
    count = folders.count()
    moved = folders.repartition(max(1, count)).mapInArrow(move, "moved long").agg(F.sum("moved").alias("moved")).first()["moved"] or 0
    system, path = store(staged)
    system.delete_dir(path)
    return moved


def put_objects(objects: DataFrame, base: str) -> str:
    """Each row's content (text or binary) as the object `key` under base."""
    staged = f"{base.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    publish(objects.sparkSession, stage_objects(objects, staged), base.rstrip("/"))
    return base


#: What is told of a file, and of an entry of a folder.
FILE = "path string, modificationTime timestamp, length long"
ENTRY = pa.schema([("folder", pa.bool_()), ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
#: Entries of a batch; bytes of contents of a batch, and files and bytes of a task, beyond which another one begins.
ENTRIES, BATCH_BYTES, TASK_FILES, TASK_BYTES = 10_000, 4 << 20, 4096, 64 << 20


def is_folder(path: str | list[str]) -> bool:
    """Whether path is one folder of a file system that tasks can open."""
    try:
        system, root = store(path)
        return system.get_file_info(root).type == fs.FileType.Directory
    except (TypeError, ValueError, OSError):  # several, a pattern, or a scheme that only Spark knows
        return False


def _prefix(system: fs.FileSystem, path: str, root: str) -> str:
    """What comes before a path in its file system where Spark names it."""
    if isinstance(system, fs.LocalFileSystem):
        return "file:"
    at = urlparse(path)
    return f"{at.scheme}://" if root.startswith(at.netloc) else f"{at.scheme}://{at.netloc}"


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[bool, str, int, int]]:
    """Whether it is a folder, path, microseconds and bytes of each entry, but for those that Spark hides; local ones are not held in memory."""
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not hidden(e.name):
                    at = e.stat()
                    yield e.is_dir(), f"{folder.rstrip('/')}/{e.name}", at.st_mtime_ns // 1_000_000 * 1000, at.st_size
    else:
        for e in system.get_file_info(fs.FileSelector(folder)):
            if not hidden(e.base_name):
                yield e.type == fs.FileType.Directory, e.path, (e.mtime_ns or 0) // 1_000_000 * 1000, e.size or 0


def walked(spark: SparkSession, base: str) -> DataFrame:
    """path, modificationTime, length of every file under a folder that has bytes, as Spark's readers name them: a level of folders is a job, a folder
    is listed by one task. The driver gets no names of files or folders."""
    system, root = store(base)
    before = _prefix(system, base, root)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(base)
        rows: list[tuple] = []
        made = lambda: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), ENTRY.types, strict=True)], schema=ENTRY)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for e in _entries(system, folder):
                    rows.append(e)
                    if len(rows) == ENTRIES:
                        yield made()
                        rows.clear()
        if rows:
            yield made()

    folders = spark.range(1).select(F.lit(root).alias("path"))
    files = []
    while True:
        level = saved(folders.mapInArrow(entries, f"folder boolean, {FILE}"), "listing")
        files.append(level.filter("NOT folder AND length > 0").select(F.concat(F.lit(before), "path").alias("path"), "modificationTime", "length"))
        below = level.filter("folder").select("path")
        count = below.count()
        if not count:
            break
        folders = below.repartition(min(count, max(spark.sparkContext.defaultParallelism * 4, count // 64)))
    found = files[0]
    for more in files[1:]:
        found = found.unionByName(more)
    return found


def with_contents(files: DataFrame, base: str, tasks: int = 0) -> DataFrame:
    """Files (path, modificationTime, length) under base with their content, read by tasks that have some files each. Without a number of tasks, the driver
    gets how many files and bytes there are, to choose one."""
    spark = files.sparkSession
    system, root = store(base)
    skip = len(_prefix(system, base, root))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(base)
        for batch in batches:
            first, size, contents = 0, 0, []
            for i, path in enumerate(batch.column("path")):
                with system.open_input_stream(path.as_py()[skip:]) as file:
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(contents))
                    yield pa.record_batch([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    first, size, contents = i + 1, 0, []

    if not tasks:
        total = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first()
        tasks = max(total["files"] // TASK_FILES, (total["bytes"] or 0) // TASK_BYTES, min(total["files"], spark.sparkContext.defaultParallelism), 1)
    return files.repartition(tasks).mapInArrow(read, f"{FILE}, content binary")


def listed(spark: SparkSession, base: str, contents: bool = False) -> DataFrame:
    """key, length (and content) of every object under base that has bytes: like Spark's readers, it lists no empty files."""
    found = walked(spark, base)
    found = with_contents(found, base) if contents else found
    return found.select(key_below(F.col("path"), base).alias("key"), "length", *(["content"] if contents else []))


def key_below(path: Column, base: str) -> Column:
    """What follows base in a path."""
    return F.substring_index(path, f"{store(base)[1].rstrip('/')}/", -1)
