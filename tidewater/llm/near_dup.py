"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

SuperMinHash: an element's hash seeds a random permutation of the signature's slots; the slot drawn in step j gets the
value j + r (r in [0, 1)), and each slot keeps its least value. A document is done after the first step whose number
exceeds its largest slot, which for large sets is step 0 or 1. All elements of a batch take a step together.

Documents with equal sets are one class, shown by its smallest doc_id; only classes are banded. Classes that agree in a
band share a bucket. A bucket compares all its classes with its smallest one (its hub); pairs whose signatures agree in
too few slots to reach the threshold are left out, the others are confirmed on their full sets. Where a bucket's
classes are not all connected by then, it is open, and open buckets of one hub are a group. Large groups are divided by what
their sets differ in from a common one (`_divided`); no two classes that may be linked are parted. In what is left of them, and in
small groups, the classes outside the largest component are compared with all others, in blocks: first by
signatures, then on the full sets of those that have a partner by signature. No group is cut short. What is said of a class,
bucket or group is an aggregate that is written before rows are joined to it, so Spark can split the rows of a hot one.

Sets hold 64-bit hashes of shingles. Null texts and texts without words have no shingles and are linked with nothing.
Rows that share a doc_id are one node, with the links of all of them. A row with a null doc_id is linked with nothing.
Other columns are left out. Ties: a group shows its smallest doc_id. An empty table gives no rows. A text is held whole, with
some ten numbers for each of its words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import in_batches, maybe_broadcast, saved, tidy
from tidewater.llm.components import components

#: Words of a shingle where nothing else is asked for.
WORDS = 5
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Share of equal slots below which a pair is not confirmed: over six deviations below 0.8 (probability 2e-9).
LEAST_AGREEMENT = 0.6
#: Classes of a block in which buckets are compared beyond their hubs, by signatures and by sets, and about how many rows of blocks a task takes.
BLOCK, SET_BLOCK, TASK_ROWS = 2048, 256, 2000
#: Classes of a group that is divided no further, how often one is, and how many parts its classes go to at most, on average.
FEW, LEVELS, SPREAD = 256, 6, 32
#: About how many classes of a large group say what its common set is.
PICKS = 64
CHUNK_BYTES = 512 << 10
U = np.uint64
_random = np.random.default_rng(8)
LETTERS = _random.integers(0, 1 << 64, 256, U)
LETTERS[65:91] = LETTERS[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words_each: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a byte buffer, one after another, and where each text's begin.

    Words are runs of bytes other than blanks; A-Z count as a-z. A shingle is some words in a row, or all if the text has fewer.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.empty(0, U), np.zeros(n + 1, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    blank = SPACE[data]
    begins = ~blank
    begins[1:] &= blank[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, U), np.zeros(n + 1, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    inside = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    terms = LETTERS[data[starts[0] :]] * _powers(int(lengths.max()))[inside]
    terms[blank[starts[0] :]] = 0
    words = mix(np.add.reduceat(terms, starts - starts[0]))
    bounds = np.searchsorted(starts, offsets)
    runs = words
    for k in range(1, words_each):
        runs = runs[: max(0, len(words) - k)] * BASE + words[k:]
    runs, sets = mix(runs), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if 0 < b - a < words_each:
            few = words[a : a + 1]
            for k in range(a + 1, b):
                few = few * BASE + words[k : k + 1]
            sets.append(mix(few ^ BASE))
            continue
        s = np.sort(runs[a : max(a, b - words_each + 1)])
        sets.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of the sets that lie one after another in `elements`; of empty sets, all ones."""
    n = len(bounds) - 1
    sig = np.full((n, slots), np.iinfo(U).max, U)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    places = None  # each element's permutation so far, from the second step on
    for j in range(slots):
        r = mix(elements + U((2 * j + 1) * int(BASE) % (1 << 64)))
        k = j + (mix(r) % U(slots - j)).astype(np.int64)
        each = np.arange(len(k))
        slot = k if places is None else places[each, k].astype(np.int64)
        np.minimum.at(sig.reshape(-1), owner * slots + slot, (U(j) << U(48)) | (r >> U(16)))
        going = ((sig.max(1) >> U(48)) > U(j))[owner]
        if not going.any():
            break
        elements, owner, k, each = elements[going], owner[going], k[going], np.arange(int(going.sum()))
        places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(k), 1)) if places is None else places[going]
        places[each, k] = places[:, j]
    return sig


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with about CHUNK_BYTES of text, their bytes and offsets."""
    for batch in batches:
        text = batch.column("text").fill_null("")
        ends = np.cumsum(np.asarray(pa.compute.binary_length(text), np.int64))
        cuts = np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1] if len(ends) else 0, CHUNK_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                part = pa.concat_arrays([text.slice(a, b - a)])
                offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + b - a + 1].astype(np.int64)
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                yield batch.slice(a, b - a), data, offsets - offsets[0]


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each set."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
    return total[bounds[1:]] - total[bounds[:-1]]


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), f1 and f2 (128 bits that name the set), sig (16 bits of each slot), bands."""

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _chunks(batches):
            elements, bounds = shingle_sets(data, offsets, words)
            sig = superminhash(elements, bounds)
            bands = mix((mix(sig).reshape(len(sig), BANDS, ROWS) * _powers(ROWS + 1)[1:]).sum(2, dtype=U) + np.arange(BANDS, dtype=U) * BASE)
            sizes, short = np.diff(bounds), mix(sig).astype("<u2").tobytes()
            columns = [
                batch.column("doc_id"),
                pa.array(sizes),
                pa.array(_sums(mix(elements + BASE), bounds).view(np.int64)),
                pa.array(_sums(mix(elements ^ BASE), bounds).view(np.int64)),
                pa.array([short[i : i + 2 * SLOTS] for i in range(0, len(short), 2 * SLOTS)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "sig", "bands"])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, sig binary, bands array<long>")


def shingles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, elements: the full set of each row, as sorted 64-bit hashes."""

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _chunks(batches):
            elements, bounds = shingle_sets(data, offsets, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["doc_id", "elements"])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(sets, "doc_id long, elements binary")


def _plausible(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose signatures agree in enough slots."""

    @tidy
    def agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, y = (np.frombuffer(b"".join(frame[c]), "<u2").reshape(-1, SLOTS) for c in ("sa", "sb"))
                frame = frame[(x == y).mean(1) >= LEAST_AGREEMENT]
            yield frame[["a", "b"]]

    one = signed.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = signed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold
    return pairs.join(one, "a").join(two, "b").filter(near).select("a", "b", "sa", "sb").mapInPandas(agree, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, words: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets; a pair may come more than once where rows share a doc_id."""
    pairs = saved(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = saved(shingles(docs.join(maybe_broadcast(ids), "doc_id"), words), "sets")

    @tidy
    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = []
            for x, y in zip(frame["ea"], frame["eb"], strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield frame.loc[ok, ["a", "b"]]

    one = wanted.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"))
    two = wanted.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "eb").mapInPandas(confirm, "a long, b long")


def _linked_across(x: list[np.ndarray], y: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which sets of x and y reach the threshold: shared elements are counted by products of their membership tables."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    both = np.zeros((len(x), len(y)), np.float32)

    def table(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        hit = part[at] == flat
        out = np.zeros((len(sets), len(part)), np.float32)
        out[row[hit], at[hit]] = 1
        return out

    for k in range(0, len(shared), 4096):
        both += table(x, shared[k : k + 4096]) @ table(y, shared[k : k + 4096]).T
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    both = both.astype(np.int64)
    return 100 * both >= threshold * (sizes - both)


def _agreeing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which signatures of x and y agree in LEAST_AGREEMENT of their slots or more."""
    a, b = (np.frombuffer(b"".join(s), "<u2").reshape(-1, SLOTS) for s in (x, y))
    same = np.zeros((len(a), len(b)), np.uint16)
    for k in range(SLOTS):
        same += a[:, k, None] == b[None, :, k]
    return same >= LEAST_AGREEMENT * SLOTS


def _opened(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, rep, root) of groups with several roots, with the group's size, its main root (that of most rows), and how many rows have others."""
    by_root = rows.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    mains = by_root.groupBy(group).agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size")).filter(F.col("most.n") < F.col("size"))
    return rows.join(saved(mains.select(group, "size", F.col("most.root").alias("main"), (F.col("size") - F.col("most.n")).alias("outside")), "mains"), group)


def _pivots(rows: DataFrame) -> DataFrame:
    """bucket, pivot: the elements that over half of some PICKS sets of a group have. Any set would do; a central one leaves few differences."""

    @tidy
    def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [np.frombuffer(e, np.int64) for e in frame["elements"]]
            yield pd.DataFrame({"bucket": np.repeat(frame["bucket"].to_numpy(), [len(e) for e in sets]), "element": np.concatenate([np.empty(0, np.int64), *sets])})

    picks = saved(rows.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("size") / PICKS))) == 0).select("bucket", "elements"), "picks")
    among = picks.groupBy("bucket").agg(F.count(F.lit(1)).alias("picks"))
    counts = picks.mapInPandas(elements, "bucket long, element long").groupBy("bucket", "element").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(among, "bucket").filter(F.col("n") * 2 > F.col("picks")).groupBy("bucket").agg(F.collect_list("element").alias("pivot"))


def _differences(large: DataFrame, docs: DataFrame, threshold: int, words: int) -> DataFrame:
    """bucket, rep, root, cost, need, delta for each class of large groups (bucket, rep, root, size).

    With a pivot P, D the elements of P that x lacks and A those that x has beyond it, cost(x) is 100 |D| + threshold |A|, and need
    (100 - threshold) |P|. By arithmetic, x and y reach the threshold if and only if cost(x) + cost(y) <= need + (100 +
    threshold) s, where s elements are in D of both or in A of both. delta has D (odd) and A (even), the rarest in the group first,
    without those of a single class, which are in no s.
    """

    @tidy
    def differ(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cost, need, delta = [], [], []
            for elements, pivot in zip(frame["elements"], frame["pivot"], strict=True):
                x, p = np.frombuffer(elements, np.int64), np.asarray([] if pivot is None else pivot, np.int64)
                less, more = np.setdiff1d(p, x, assume_unique=True), np.setdiff1d(x, p, assume_unique=True)
                cost.append(100 * len(less) + threshold * len(more))
                need.append((100 - threshold) * len(p))
                delta.append(np.concatenate([less | 1, more & ~1]))
            yield frame[["bucket", "rep", "root", "part"]].assign(cost=cost, need=need, delta=delta)

    ids = large.select(F.col("rep").alias("doc_id")).distinct()
    sets = saved(shingles(docs.join(maybe_broadcast(ids), "doc_id"), words), "large-sets").select(F.col("doc_id").alias("rep"), "elements", F.xxhash64("elements").alias("part"))
    rows = saved(large.join(sets, "rep"), "large-rows")
    pivots = saved(_pivots(rows), "pivots")
    schema = "bucket long, rep long, root long, part long, cost long, need long, delta array<long>"
    found = saved(in_batches(rows.join(pivots, "bucket", "left")).mapInPandas(differ, schema), "differences")
    pieces = found.select("bucket", "rep", "part", F.explode("delta").alias("element"))
    shared = saved(pieces.groupBy("bucket", "element").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "shared")
    pieces = pieces.join(shared, ["bucket", "element"]).groupBy("bucket", "rep", "part").agg(F.sort_array(F.collect_list(F.struct("size", "element")))["element"].alias("delta"))
    return found.drop("delta").join(pieces, ["bucket", "rep", "part"], "left").drop("part").withColumn("delta", F.coalesce("delta", F.array().cast("array<bigint>")))


def _divided(large: DataFrame, docs: DataFrame, threshold: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) in large groups (bucket, rep, root, size), and smaller groups (bucket, rep, root) that hold all other pairs that may be linked.

    In a group whose classes share `level` differences from the pivot, those that cost little are linked with the cheapest one at once.
    A pair in which one costs more must share another difference. So each class goes to the groups of its next shared one; as many differences
    must be shared, only its rarest ones can be the next. Classes without enough shared ones have no partner and go nowhere.
    A group that would be spread too far, or is large after LEVELS divisions, is given back as it is.
    """
    each = 100 + threshold

    @tidy
    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stop = []
            for d, at, cost, need, least, sure, level in zip(*(frame[c] for c in ("delta", "at", "cost", "need", "least", "sure", "level")), strict=True):
                # a sure one's partner costs need + each * level - least + 1 at least, another's `least`
                missing = -(-(cost - least + 1) // each) if sure else -(-(cost + least - need) // each) - level
                stop_at = len(d) - missing + 1
                # a partner pays for each difference that it shares, so the sum of what is left to share must make up for the cost
                gains = np.cumsum(np.where(np.asarray(d[at:], np.int64)[::-1] & 1, each - 100, each - threshold))[::-1]
                enough = at + int((level * max(each - 100, each - threshold) + gains >= cost - need).sum())
                stop.append(max(at, min(stop_at, enough)))
            yield frame[["bucket", "rep", "root", "cost", "need", "delta", "at"]].assign(stop=stop)

    links, left = [], []
    state = _differences(large, docs, threshold, words).withColumn("at", F.lit(0).cast("bigint"))
    for level in range(LEVELS + 1):
        state = saved(state, "state")
        whole = state.groupBy("bucket").agg(F.min(F.struct("cost", "rep", "root")).alias("cheapest"), F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") < F.col("high"))
        state = saved(state.join(saved(whole, "whole"), "bucket"), "met")
        if level == LEVELS:
            left.append(state.select("bucket", "rep", "root"))
            break
        left.append(state.filter(F.col("n") <= FEW).select("bucket", "rep", "root"))
        many = state.filter(F.col("n") > FEW).withColumn("sure", F.col("cost") + F.col("cheapest.cost") <= F.col("need") + each * level)
        if many.isEmpty():
            break
        links.append(many.filter(F.col("sure") & (F.col("root") != F.col("cheapest.root"))).select(F.least("rep", "cheapest.rep").alias("a"), F.greatest("rep", "cheapest.rep").alias("b")))
        many = many.withColumn("root", F.when(F.col("sure"), F.col("cheapest.root")).otherwise(F.col("root")))
        many = many.select("bucket", "rep", "root", "cost", "need", "delta", "at", F.col("cheapest.cost").alias("least"), "sure", F.lit(level).cast("bigint").alias("level"))
        many = saved(in_batches(many).mapInPandas(reach, "bucket long, rep long, root long, cost long, need long, delta array<long>, at long, stop long"), "reach")
        wide = many.groupBy("bucket").agg((F.sum(F.col("stop") - F.col("at")) > SPREAD * F.count(F.lit(1))).alias("wide"))
        many = many.join(saved(wide, "spread"), "bucket")
        left.append(many.filter("wide").select("bucket", "rep", "root"))
        ahead = many.filter(~F.col("wide") & (F.col("stop") > F.col("at"))).withColumn("i", F.explode(F.sequence("at", F.col("stop") - 1)))
        state = ahead.select(F.xxhash64("bucket", F.col("delta")[F.col("i").cast("int")]).alias("bucket"), "rep", "root", "cost", "need", "delta", (F.col("i") + 1).alias("at"))
    united = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    return united(links), united(left)


def _across(open_buckets: DataFrame, shown: DataFrame, docs: DataFrame, threshold: int, words: int) -> DataFrame:
    """Links between classes that share a group of open buckets (bucket, rep, root) but not yet a component."""
    groups = saved(_opened(open_buckets.distinct(), "bucket"), "groups")
    large = groups.filter(F.col("size") > FEW)
    if large.isEmpty():
        return _in_blocks(groups, shown, docs, threshold, words)
    links, left = _divided(large.select("bucket", "rep", "root", "size"), docs, threshold, words)
    smaller = _opened(saved(left.distinct(), "left"), "bucket").select(groups.columns)
    return links.unionByName(_in_blocks(saved(groups.filter(F.col("size") <= FEW).unionByName(smaller), "groups"), shown, docs, threshold, words))


def _in_blocks(open_buckets: DataFrame, shown: DataFrame, docs: DataFrame, threshold: int, words: int) -> DataFrame:
    """Links between classes that share an open bucket (bucket, rep, root, size, main, outside) but not yet a component.

    Classes outside the bucket's main component meet all of its classes, block by block: signatures first, then the full sets
    of those that agree with some class of another component. A block returns a link for each class and each component that
    it reaches, not every pair.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("bigint")
    own = lambda n: F.pmod(F.xxhash64("rep"), blocks(n))
    outer = open_buckets.filter(F.col("root") != F.col("main")).select("bucket", own(F.col("outside")).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(F.col("size")) - 1)).alias("j"), "rep", "root", F.lit(True).alias("outer"))
    inner = open_buckets.select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(F.col("outside")) - 1)).alias("i"), own(F.col("size")).alias("j"), "rep", "root", F.lit(False).alias("outer"))
    met = saved(outer.unionByName(inner), "blocks")
    columns = met.columns

    def in_tasks(rows: DataFrame, beside: DataFrame) -> DataFrame:
        # the written rows are counted: a count of the joined ones would make the join twice
        return rows.join(beside, "rep").withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, rows.count() // TASK_ROWS)))).groupBy("task")

    def pairs(frame: pd.DataFrame, column: str, test) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
        for _, block in frame.groupby(["bucket", "i", "j"], sort=False):
            x, y = block[block["outer"]], block[~block["outer"]]
            if len(x) and len(y):
                yield x, y, test(x[column].tolist(), y[column].tolist()) & (x["root"].to_numpy()[:, None] != y["root"].to_numpy()[None, :])

    def sift(frame: pd.DataFrame) -> pd.DataFrame:
        found, most = [frame.iloc[:0]], 2 * BLOCK  # far more parts than a block has
        for x, y, near in pairs(frame, "sig", _agreeing):
            for a in range(0, len(x), SET_BLOCK):
                for b in range(0, len(y), SET_BLOCK):
                    part = near[a : a + SET_BLOCK, b : b + SET_BLOCK]
                    for some, hit in ((x.iloc[a : a + SET_BLOCK], part.any(1)), (y.iloc[b : b + SET_BLOCK], part.any(0))):
                        if hit.any():
                            found.append(some[hit].assign(i=some["i"] * most + a // SET_BLOCK, j=some["j"] * most + b // SET_BLOCK))
        return pd.concat(found)[columns]

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 2), np.int64)]
        test = lambda x, y: _linked_across([np.frombuffer(e, U) for e in x], [np.frombuffer(e, U) for e in y], threshold)
        for x, y, linked in pairs(frame, "elements", test):
            ry, ix, iy = y["root"].to_numpy(), x["rep"].to_numpy(), y["rep"].to_numpy()
            a, b = np.nonzero(linked)
            _, first = np.unique(np.stack([a, ry[b]], 1), axis=0, return_index=True)
            out.append(np.stack([np.minimum(ix[a], iy[b]), np.maximum(ix[a], iy[b])], 1)[first])
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    near = saved(in_tasks(met, shown.select("rep", "sig")).applyInPandas(sift, met.schema), "agreeing")
    elements = saved(shingles(docs.join(maybe_broadcast(near.select(F.col("rep").alias("doc_id")).distinct()), "doc_id"), words), "open-sets").withColumnRenamed("doc_id", "rep")
    return in_tasks(near, elements).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: links where 100 * shared >= threshold * united."""
    signed = saved(signatures(docs, words), "signatures")
    named = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    name = ["n", "f1", "f2"]
    # equal sets have equal signatures and bands
    shown = saved(named.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "shown")
    in_bands = shown.select("rep", F.explode("bands").alias("bucket"))
    hubs = saved(in_bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "hubs")
    buckets = saved(in_bands.join(hubs, "bucket"), "buckets")
    first = buckets.filter(F.col("rep") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    roots = components(_confirmed(_plausible(first, shown, threshold), docs, threshold, words))
    placed = saved(buckets.filter(F.col("size") > 2).join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "hub", F.coalesce("root", "rep").alias("root")), "placed")
    several_roots = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") < F.col("high")).select("bucket")
    open_buckets = placed.join(saved(several_roots, "open"), "bucket").select(F.col("hub").alias("bucket"), "rep", "root")
    more = _across(open_buckets, shown, docs, threshold, words)

    # rows of one doc_id with unlike sets are one node
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).select("doc_id")
    split = named.select("doc_id", *name).join(several, "doc_id").join(shown.select("rep", *name), name).filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more).unionByName(split))
    of_class = saved(shown.join(final, F.col("rep") == F.col("node"), "left").select(*name, F.coalesce("root", "rep").alias("root")), "roots")
    members = named.select("doc_id", *name).join(of_class, name).groupBy("doc_id").agg(F.min("root").alias("root"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(members, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold: int = 80, words: int = WORDS) -> DataFrame:
    """docs with one document of each group; all columns kept. Of rows that share a kept doc_id, all stay."""
    gone = near_duplicates(docs, threshold, words).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
