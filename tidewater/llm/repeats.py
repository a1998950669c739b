"""Removal of repeated substrings: every byte covered by a string of `length` bytes that starts anywhere else too.

1. Each place's string is filed under its least-hashed run of GRAM bytes (the leftmost, if several are equal). Neighbouring
   places filed under the same run form a segment. Equal strings are filed under equal runs at equal distances, so only
   segments whose run occurs twice matter. Segments with equal bytes are one kind, of which two go on: more add nothing.
2. Kinds are compared column by column, in collections of runs with about BUCKET kinds: they lie with their runs in one column,
   and from the last column to the first each round puts one symbol of every string in front, so the collection's positional
   Burrows-Wheeler order follows from a stable sort of one column, and the common prefixes of neighbours from range minima of
   the round before. Neighbours with a common prefix of `length` at a place are repeated there. A round reads one column; only
   the order, the common prefixes and the collection's columns are held.
3. A run that more than LARGEST kinds share is made longer, by half of what a string holds beside it: on the left for the
   places whose strings reach so far, on the right for the others. This is done again until no run has more, so no
   collection is larger, and all are compared by columns.
4. Repeated places go back to every occurrence of their kind, and each text is cut.

Kinds are named by 128 bits. Null texts count as empty. Rows are told apart by (doc_id, text); repeated rows are all kept, and
repeat each other. Texts of any length are hashed in parts. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import in_batches, saved, tidy

LENGTH, GRAM = 200, 80
BUCKET, LARGEST = 2000, 4096
#: Bytes hashed at a time, and the bits that hold a place among them.
CHUNK_BYTES, PLACE_BITS = 512 << 10, 24
#: Bits of the number of places and of the distance in a spot.
SPOT_BITS = 16
U = np.uint64
_random = np.random.default_rng(10)
BYTES = _random.integers(0, 1 << 64, 256, U)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of `gram` bytes, from runs of 1, 2, 4, ... bytes."""
    done, out, size, part = 0, None, 1, BYTES[data]
    while True:
        shift = U(pow(BASE, size, 1 << 64))
        if gram & size:
            n = len(data) - done - size + 1
            out = part if out is None else out[:n] * shift + part[done : done + n]
            done += size
        if size * 2 > gram:
            return mix(out)
        part = part[:-size] * shift + part[size:]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of the texts in a byte buffer: text, first place, number of places, distance from there to the run, key, content hash."""
    places = np.maximum(np.diff(offsets) - (length - 1), 0)
    if not places.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none, none.view(U), none.view(U)
    grams = gram_hashes(data, gram)
    low = U((1 << PLACE_BITS) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), length - gram + 1)
    text = np.repeat(np.arange(len(places)), places)
    at = np.arange(len(text)) - np.repeat(np.cumsum(places) - places, places) + np.repeat(offsets[:-1], places)
    run = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(first, len(run)))
    begin, end = at[first], at[first] + count + (length - 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[data] * powers(BASE, len(data)), dtype=U)])
    content = mix((sums[end] - sums[begin]) * powers(INVERSE, len(data))[begin] + (end - begin).astype(U))
    return text[first], begin - offsets[text[first]], count, run[first] - begin, grams[run[first]], content


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Parts of batches of about CHUNK_BYTES of text: rows, bytes, offsets, and the place in the text where the bytes begin.

    A longer text comes in several parts that overlap by length - 1 bytes.
    """
    for batch in batches:
        text = batch.column("text").fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(text), np.int64))
        cuts = np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1] if len(ends) else 0, CHUNK_BYTES)) + 1
        cuts = np.unique(np.concatenate([[0], cuts, cuts - 1, [batch.num_rows]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = pa.concat_arrays([text.slice(a, b - a)])
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + b - a + 1].astype(np.int64)
            data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            rows, offsets = batch.slice(a, b - a), offsets - offsets[0]
            if b - a == 1 and len(data) > 8 * CHUNK_BYTES:
                for x in range(0, len(data) - length + 1, 8 * CHUNK_BYTES):
                    piece = data[x : x + 8 * CHUNK_BYTES + length - 1]
                    yield rows, piece, np.array([0, len(piece)]), x
            else:
                yield rows, data, offsets, 0


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, tid and lists of key, content, spot: the segments of each text. spot packs first place, places and distance."""
    if not 0 <= length - gram < (1 << SPOT_BITS) - 1:
        raise ValueError(f"length must be from {gram} to {gram + (1 << SPOT_BITS) - 2}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, base in _slices(batches, length):
            text, first, count, distance, key, content = segments(data, offsets, length, gram)
            bounds = pa.array(np.searchsorted(text, np.arange(rows.num_rows + 1)), pa.int32())
            spot = (first + base) << 2 * SPOT_BITS | count << SPOT_BITS | distance
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (key.view(np.int64), content.view(np.int64), spot)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tid"), *lists], ["doc_id", "tid", "key", "content", "spot"])

    found = in_batches(docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")).mapInArrow(find, f"doc_id {kind}, tid long, key array<long>, content array<long>, spot array<long>")
    return found.filter(F.size("key") > 0).withColumn("row", F.monotonically_increasing_id())


def repeated_places(strings: list[bytes], distances: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which places of each string (strings x places) have an equal place in another string, by rounds over columns.

    Strings lie with the place at their distance, where their run begins, in one column.
    """
    n, widest = len(strings), length - gram + 1
    columns = widest - 1 + length
    shift = widest - 1 - distances
    found = np.zeros((n, widest), bool)
    table = np.zeros((n, columns), np.uint16)
    for i, s in enumerate(strings):
        table[i, shift[i] : shift[i] + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    table = np.ascontiguousarray(table.T)
    order, common = np.arange(n), np.zeros(n, np.int64)  # common[i]: with the one before in order
    for column in range(columns - 1, -1, -1):
        symbols = table[column][order]
        back = np.argsort(symbols, kind="stable")
        same = np.flatnonzero((symbols[back[1:]] == symbols[back[:-1]]) & (symbols[back[1:]] > 0))
        after = np.zeros(n, np.int64)
        if len(same):
            ranges = np.stack([back[same] + 1, back[same + 1] + 1], 1).reshape(-1)
            after[same + 1] = np.minimum.reduceat(np.append(common, 0), ranges)[::2] + 1
        order, common = order[back], after
        if column < widest:
            long = common >= length
            both = long | np.append(long[1:], False)
            found[order[both], column] = True
    # from columns back to places
    at = np.arange(widest)[None, :] - shift[:, None]
    out = np.zeros((n, widest), bool)
    i, c = np.nonzero(found & (at >= 0))
    out[i, at[i, c]] = True
    return out


def _ranges(row: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


STRINGS = "key long, content long, copies long, distance int, places int, bytes binary"


def _strings(kinds: DataFrame, found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """STRINGS of kinds (key, content, copies, row, spot): the bytes of one segment of each."""
    spots = kinds.groupBy("row").agg(F.collect_list(F.struct("key", "content", "copies", "spot")).alias("spots"))
    # the parts of one long text are rows of their own
    named = spots.join(found.select("row", "doc_id", "tid"), "row").groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    both = texts.join(named.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")))

    @tidy
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = (1 << SPOT_BITS) - 1
        for frame in frames:
            out = []
            for text, spots in zip(frame["text"], frame["spots"], strict=True):
                text = text.encode()
                for s in spots:
                    first, count, distance = s["spot"] >> 2 * SPOT_BITS, s["spot"] >> SPOT_BITS & low, s["spot"] & low
                    out.append((s["key"], s["content"], s["copies"], distance, count, text[first : first + count + length - 1]))
            yield pd.DataFrame(out, columns=["key", "content", "copies", "distance", "places", "bytes"])

    # repeated rows give a kind more than once; which is taken does not matter
    return both.select("text", "spots").mapInPandas(cut, STRINGS)


def _compared(strings: DataFrame, number: int, length: int, gram: int) -> DataFrame:
    """key, content, since, until: repeated places of kinds, by columns, in collections of about BUCKET kinds."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["key", "content"])
        twice = np.repeat(np.arange(len(frame)), np.minimum(frame["copies"].to_numpy(), 2))
        texts, distances = frame["bytes"].tolist(), frame["distance"].to_numpy()
        hit = repeated_places([texts[i] for i in twice], distances[twice], length, gram)
        first = np.flatnonzero(np.append(True, twice[1:] != twice[:-1]))
        out = [(k, c, a, b) for k, c, row in zip(frame["key"], frame["content"], hit[first], strict=True) for a, b in _ranges(row)]
        return pd.DataFrame(out, columns=["key", "content", "since", "until"])

    buckets = max(1, -(-number // BUCKET))
    dealt = strings.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(compare, "key long, content long, since int, until int")


def _halves(strings: DataFrame, length: int, run: int) -> DataFrame:
    """STRINGS of new kinds, with the kind (of_key, of_content) that each is a part of, and the place there where it begins.

    The run grows on the left where a place's string holds so much of it, else on the right: equal strings share the longer run.
    """
    left = (length - run + 1) // 2
    right = length - run - left + 1
    cut = F.least(F.greatest(F.col("distance") - (left - 1), F.lit(0)), F.col("places"))  # places whose strings reach far enough to the left
    parts = []
    for side, first, places, distance, start, size in ((0, F.lit(0), cut, F.col("distance") - left, F.col("distance") - left, run + left), (1, cut, F.col("places") - cut, F.col("distance") - cut, F.col("distance"), run + right)):
        key = F.xxhash64("key", F.lit(side), F.substring("bytes", start + 1, F.lit(size)))
        part = strings.filter(places > 0).select(key.alias("key"), "copies", distance.cast("int").alias("distance"), places.cast("int").alias("places"), F.substring("bytes", first + 1, places + (length - 1)).alias("bytes"), F.col("key").alias("of_key"), F.col("content").alias("of_content"), first.cast("int").alias("begin"))
        parts.append(part.withColumn("content", F.xxhash64("distance", "bytes")))
    return parts[0].unionByName(parts[1])


def _repeated(strings: DataFrame, length: int, gram: int, run: int) -> DataFrame:
    """key, content, since, until of kinds (STRINGS, written) that share a run of `run` bytes with many others."""
    halves = saved(_halves(strings, length, run), "halves")
    kinds = halves.groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("distance", "places", "bytes")).alias("one")).select("key", "content", "copies", "one.*")
    kinds = saved(kinds, "half-kinds")
    many = saved(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGEST).select("key"), "many")
    usual = kinds.join(many, "key", "left_anti")
    found = _compared(usual, usual.count(), length, gram)
    longer = run + (length - run + 1) // 2
    if longer < length and not many.isEmpty():
        found = found.unionByName(_repeated(saved(kinds.join(many, "key", "left_semi"), "longer"), length, gram, longer))
    return halves.join(saved(found, "repeated"), ["key", "content"]).select(F.col("of_key").alias("key"), F.col("of_content").alias("content"), (F.col("begin") + F.col("since")).alias("since"), (F.col("begin") + F.col("until")).alias("until"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, tid, spans (array of first, after): places whose strings of `length` bytes start anywhere else too."""
    found = saved(find_segments(docs, length, gram), "segments")
    lists = found.select("row", F.inline(F.arrays_zip("key", "content", "spot")))
    # written first, so that both sides of the join are dealt anew and Spark can split a hot run's rows
    keys = saved(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key"), "keys")
    several = saved(lists.join(keys.hint("shuffle_hash"), "key"), "several")
    kinds = several.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "spot")).alias("one")).select("key", "content", "copies", "one.row", "one.spot")
    kinds = saved(kinds, "kinds")
    many = saved(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGEST).select("key"), "many")
    if many.isEmpty():
        repeated = _compared(_strings(kinds, found, docs, length), kinds.count(), length, gram)
    else:
        usual = kinds.join(many, "key", "left_anti")
        repeated = _compared(_strings(usual, found, docs, length), usual.count(), length, gram)
        hot = _strings(kinds.join(many, "key", "left_semi"), found, docs, length).dropDuplicates(["key", "content"])
        repeated = repeated.unionByName(_repeated(saved(hot, "strings"), length, gram, gram))
    repeated = saved(repeated, "repeated")
    start = F.shiftright("spot", 2 * SPOT_BITS)
    places = several.join(repeated, ["key", "content"]).select("row", F.struct((start + F.col("since")).alias("first"), (start + F.col("until")).alias("after")).alias("span"))
    per_row = places.groupBy("row").agg(F.collect_list("span").alias("spans"))
    return per_row.join(found.select("row", "doc_id", "tid"), "row").groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept(text: bytes, spans: list, length: int) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    out, at, gone, runs, reach = [], 0, 0, 0, -1
    for first, after in sorted((s["first"], s["after"]) for s in spans):
        end = after - 1 + length
        if first > reach:
            runs += 1
            out.append(text[at:first])
        if end > reach:
            gone += end - max(first, reach, 0)
            reach = at = end
    out.append(text[at:])
    return b"".join(out), gone, runs


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row."""
    spans = repeated_spans(docs, length, gram)
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    both = texts.join(spans.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")), "left").select(F.col("d").alias("doc_id"), "text", "spans")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            cuts = [_kept(t, s or [], length) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [c[1] for c in cuts], [c[2] for c in cuts])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array([c[0] for c in cuts], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(both).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
