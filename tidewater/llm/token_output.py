"""Token ids as Parquet list columns, written in document order and read back selectively.

Texts are dealt by ranges of doc_id, each range is encoded in order and becomes one file: row groups and pages
have a set size, ids are dictionary encoded and counters delta encoded (Parquet's second writer version), and the
writer adds page indexes, so one document's ids or the counters alone can be read without the rest.

A worker holds about ten times CHUNK_BYTES, or of the longest text if that is more, and its store of words.

Null texts count as empty, and get the end id only. Rows that share a doc_id are all kept, ordered by text. A null
doc_id sorts first. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import in_batches, new_path, tidy

#: Parquet writer settings: bytes of a row group and of a page, second writer version for delta encoded counters.
FILE_OPTIONS = {"parquet.block.size": 64 << 20, "parquet.page.size": 256 << 10, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "zstd"}
#: Bytes of names and ids of words that an encoder keeps; beyond them it starts anew. Bytes of text encoded at a time.
STORE_BYTES, CHUNK_BYTES = 16 << 20, 512 << 10
#: A letter, and a mark that no token joins to a letter before it. Words of one kind, that are one token or more each.
JOINT, PLAIN = r"([a-z])([!-&(-/:-@\[-`{-~])", re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
#: Plain words that are encoded in one call.
JOINED = 500
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _names(words: pa.StringArray) -> np.ndarray:
    """Two 64-bit hashes of each word (words x 2)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(U) + U(1)
    lengths = np.diff(offsets)
    out = np.zeros((len(words), 2), U)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = offsets[some] - offsets[0]
        inside = np.arange(len(data)) - np.repeat(starts, lengths[some])
        for k, base in enumerate(BASES):
            powers = np.full(int(lengths.max()), base, U)
            powers = np.multiply.accumulate(powers)
            x = np.add.reduceat(data * powers[inside], starts)
            x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
            out[some, k] = x ^ (x >> U(31))
    return out


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class WordEncoder:
    """Encodes texts word by word with a store of words seen.

    The tokenizer lower-cases, drops white space and never joins across it, nor a letter with a mark behind it, so a text's
    ids are those of its words in order. Words are split and told apart by Arrow; those not yet in the store, which knows
    them by 128 bits, are encoded by the tokenizer. Texts that may hold a special token are split at white space alone.
    """

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        # Spark runs a task on each core: threads of the library would only compete, and each keeps memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.store_bytes = Tokenizer.from_file(path), store_bytes
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        # words in order of their first hash; the word without letters is always there
        self.names, self.starts, self.counts = np.zeros((1, 2), U), np.zeros(1, np.uint32), np.zeros(1, np.uint32)
        self.ids, self.used = np.empty(1 << 12, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), 0

    def _size(self) -> int:
        return self.names.nbytes + self.starts.nbytes + self.counts.nbytes + self.ids.itemsize * self.used

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
        parts, counts = [], np.zeros(len(words), np.int64)
        order = []
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            flat = np.asarray(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) == len(some):
                counts[some] = np.diff(cuts, prepend=0)
            else:
                found = self._whole([words[i] for i in some])
                counts[some] = [len(x) for x in found]
                flat = np.asarray([t for x in found for t in x], np.int64)
            parts.append(flat)
            order += some
        known = set(plain)
        rest = [i for i in range(len(words)) if i not in known]
        found = self._whole([words[i] for i in rest]) if rest else []
        counts[rest] = [len(x) for x in found]
        parts.append(np.asarray([t for x in found for t in x], np.int64))
        order = np.asarray(order + rest, np.int64)
        flat, starts = np.concatenate(parts), np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[_runs(starts, counts)], counts

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """The place in the store of each of some unlike words, which are learned if they are not there."""
        names = _names(words)
        order = np.argsort(names[:, 0])
        names = names[order]
        at = np.searchsorted(self.names[:, 0], names[:, 0])
        new = (self.names[np.minimum(at, len(self.names) - 1)] != names).any(1)
        if new.any():
            if self._size() > self.store_bytes and len(self.names) > 1:
                self._clear()
                return self._places(words)
            self._learn(names[new], at[new], words.take(pa.array(order[new])).to_pylist())
        out = np.empty(len(words), np.int64)
        out[order] = at + np.cumsum(new) - new
        return out

    def _learn(self, names: np.ndarray, at: np.ndarray, words: list[str]) -> None:
        flat, counts = self._encoded(words)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
        self.ids[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.names = np.insert(self.names, at, names, 0)
        self.starts, self.counts = np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has. Null texts have none."""
        lowered = pc.ascii_lower(texts.fill_null(""))
        if not pc.any(pc.match_substring(lowered, "<|")).as_py():
            lowered = pc.replace_substring_regex(lowered, JOINT, r"\1 \2")
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        word = self._places(coded.dictionary)[coded.indices.to_numpy()]
        counts, starts = self.counts[word].astype(np.int64), self.starts[word].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])
        return self.ids[_runs(starts, counts)], np.diff(before[bounds])


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The encoder of this worker: its store is bounded, and serves the next task too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about CHUNK_BYTES of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1] if len(ends) else 0, CHUNK_BYTES)) + 1, [batch.num_rows]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def _ids_of(batch: pa.RecordBatch, encoder: WordEncoder, end_id: int, base: int) -> tuple[pa.RecordBatch, int]:
    ids, counts = encoder.encode(pa.concat_arrays([batch.column("text")]))
    sizes = counts + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.full(int(offsets[-1]), end_id, np.int32)
    flat[_runs(offsets[:-1], counts)] = ids
    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
    out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base + offsets[:-1]), pa.array(sizes), tokens], ["doc_id", "file_start", "n_tokens", "tokens"])
    return out, base + int(offsets[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Write docs' token ids to `path`, ascending by `keys`: one file for each range of keys, in the order of the numbers in file names.

    file_start counts the ids before a document within its file, so the place in the whole output is that plus the
    totals of the earlier files.
    """
    names = [k for k in keys if k != "doc_id"]
    ordered = docs.select("doc_id", "text", *names).repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "text").select("doc_id", "text")

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = _encoder(tokenizer_path), 0
        for batch in batches:
            for rows in _parts(batch):
                part, base = _ids_of(rows, encoder, end_id, base)
                yield part

    in_batches(ordered).mapInArrow(encode, "doc_id long, file_start long, n_tokens long, tokens array<int>").write.options(**FILE_OPTIONS).parquet(path)


def file_number(name: str) -> Column:
    """The number in a data file's name: files are in the order of these, which their names are not from 100,000 files on."""
    return F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, read from the counters alone."""
    files = spark.read.parquet(path).select("doc_id", "file_start", "n_tokens", F.col("_metadata.file_name").alias("file"))
    return _with_start(files, files).select("doc_id", "start", "n_tokens")


def _with_start(files: DataFrame, counters: DataFrame) -> DataFrame:
    """file_start to start: adds the ids of all files before. One row for each file goes through the window."""
    earlier = Window.orderBy(file_number("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = counters.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    bases = totals.select(F.col("file").alias("base_file"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    return files.join(bases, files["file"] == bases["base_file"]).withColumn("start", F.col("base") + F.col("file_start"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("tokens")
        ids = np.asarray(column.flatten()).astype("<u4", copy=False)
        ends = np.asarray(column.value_lengths()).cumsum()
        crcs = [zlib.crc32(memoryview(ids[a:b])) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "file_start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "file", "file_start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write the files, read them back, and return doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, keys)
    back = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_name").alias("file"), "file_start", "n_tokens", "tokens")
    return _with_start(back.mapInArrow(_crc, "doc_id long, file string, file_start long, n_tokens long, ids_crc32 long"), back.select("file", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
