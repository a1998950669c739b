"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. The target is a flow: at any time the sources that have blocks left flow at rates in
proportion to their weights, one block a slot together, until each has given its blocks. The j-th block of a source has as release the
slot in which the flow begins it, and as deadline the slot in which the flow ends it; each slot takes the released block with the
earliest deadline. No block misses its deadline, so after any number of slots every source has given within one block of its target,
also past the end of other sources. Weights are taken as the exact fractions that they are, and times are whole numbers, so
nothing is rounded however long the run.

Of the flow, W * v blocks of a source of weight W are given at level v, or all it has; so the slot of a level is a sum over sources,
known from sums over those that end before it. The driver deals the slots one after another and notes every SEGMENT slots how many
blocks each source has given; segments are then dealt again, and written out, by tasks.

Blocks are made without gathering a source: its rows are dealt by hash to groups of about GROUP_ROWS, ordered by hash in a group,
and groups are put one after another by their counts. So the order in a source is shuffled, but the same each time.

Weights default to rows ** 0.5. A source without a weight above zero, where weights are given, gets the least one above zero. Null and empty source
names are one source. Null texts and doc_ids are kept, and so are repeated rows. Other columns are left out of the schedule.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import BROADCAST_ROWS, maybe_broadcast, saved

BLOCK_ROWS, GROUP_ROWS = 16, 4096
#: Slots between notes of how far each source is: so many, or SEGMENT_SOURCES a source if that is more.
SEGMENT, SEGMENT_SOURCES = 50_000, 8
TEMPERATURE = 0.5


class _Flow:
    """The target: sources with their blocks and weights, in the order of their ends."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, float]):
        exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
        scale = lcm(*(w.denominator for w in exact.values()))
        whole = {s: int(w * scale) for s, w in exact.items()}
        self.names = sorted(whole, key=lambda s: (Fraction(blocks[s], whole[s]), s))
        self.weights, self.blocks = [whole[s] for s in self.names], [blocks[s] for s in self.names]
        # levels of two ends, or of an end and a block, differ by more than 2 ** -bits if at all
        self.bits = 2 * max((w.bit_length() for w in self.weights), default=0) + 1
        self.ends = [(n << self.bits) // w for n, w in zip(self.blocks, self.weights, strict=True)]
        self.ended, self.left = [0], [sum(self.weights)]
        for n, w in zip(self.blocks, self.weights, strict=True):
            self.ended.append(self.ended[-1] + n)
            self.left.append(self.left[-1] - w)

    def window(self, s: int, j: int) -> tuple[int, int]:
        """Release and deadline of block j of source s."""
        w = self.weights[s]
        a, b = (bisect_right(self.ends, (k << self.bits) // w) for k in (j, j + 1))
        return self.ended[a] + j * self.left[a] // w, self.ended[b] - (-(j + 1) * self.left[b] // w)

    def slots(self, slot: int, given: list[int]) -> Iterator[int]:
        """The source of each slot from `slot` on; given, the blocks that each source has given, is kept up."""
        ready: list[tuple[int, int]] = []
        coming = [(*self.window(s, given[s]), s) for s in range(len(given)) if given[s] < self.blocks[s]]
        heapq.heapify(coming)
        while coming or ready:
            while coming and coming[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(coming)[1:])
            deadline, s = heapq.heappop(ready)
            if deadline <= slot:
                raise ValueError("a block missed its deadline")
            given[s] += 1
            slot += 1
            if given[s] < self.blocks[s]:
                release, deadline = self.window(s, given[s])
                heapq.heappush(coming, (release, deadline, s))
            yield s

    def segments(self, size: int) -> Iterator[tuple[int, int, list[int]]]:
        """First slot, slots, and what each source has given before, of runs of `size` slots."""
        given, total = [0] * len(self.names), sum(self.blocks)
        before, at = list(given), 0
        for slot, _ in enumerate(self.slots(0, given), 1):
            if slot - at == size or slot == total:
                yield at, slot - at, before
                before, at = list(given), slot


def period_slots(weights: dict[str, int]) -> list[str]:
    """The source that gives each slot of one period, in which each gives as many blocks as its weight."""
    flow = _Flow(weights, weights)
    return [flow.names[s] for s in flow.slots(0, [0] * len(flow.names))]


def phases(blocks: dict[str, int], weights: dict[str, float], size: int = SEGMENT) -> list[tuple[int, dict[str, float], dict[str, int], dict[str, int]]]:
    """First slot, weights, and each source's first block and the one after its last, of segments one after another."""
    flow = _Flow(blocks, weights)
    found = [(at, dict(zip(flow.names, before, strict=True))) for at, _, before in flow.segments(size)]
    ends = [given for _, given in found[1:]] + [{s: blocks[s] for s in flow.names}]
    return [(at, {s: weights[s] for s in first}, first, after) for (at, first), after in zip(found, ends, strict=True)]


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, tid, source, block, slot, place for every row: slots are the order of blocks, places that of rows in a block.

    The driver holds one row for each source, and a number for each source and segment: at most one for SEGMENT_SOURCES blocks.
    """
    spark = docs.sparkSession
    keys = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    rows = {r["source"]: r["n"] for r in keys.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return keys.select("doc_id", "tid", "source", *(F.lit(0).cast("bigint").alias(c) for c in ("block", "slot")), F.lit(0).alias("place"))
    least = min((w for w in (weights or {}).values() if w > 0), default=1.0)
    wanted = {s: n**TEMPERATURE if weights is None else weights[s] if weights.get(s, 0) > 0 else least for s, n in rows.items()}
    blocks = {s: -(-n // block_rows) for s, n in rows.items()}
    flow = _Flow(blocks, wanted)
    segments = spark.createDataFrame(list(flow.segments(max(SEGMENT, SEGMENT_SOURCES * len(rows)))), "slot long, slots long, given array<long>")

    def lay_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, slots, before in zip(frame["slot"], frame["slots"], frame["given"], strict=True):
                given, out = [int(n) for n in before], []
                for slot, s in zip(range(first, first + slots), flow.slots(int(first), given)):  # noqa: B905
                    out.append((flow.names[s], given[s] - 1, slot))
                yield pd.DataFrame(out, columns=["source", "block", "slot"])

    slots = segments.mapInPandas(lay_out, "source string, block long, slot long")

    groups = max(1, -(-max(rows.values()) // GROUP_ROWS))
    dealt = keys.withColumn("order", F.xxhash64("doc_id", "tid")).withColumn("group", F.pmod("order", F.lit(groups)))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "group").agg(F.count(F.lit(1)).alias("n")).select("source", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("source", "group").orderBy("order", "doc_id", "tid")) - 1
    ranked = dealt.withColumn("inside", inside).join(maybe_broadcast(counts), ["source", "group"]).withColumn("rank", F.col("earlier") + F.col("inside"))
    placed = ranked.select("doc_id", "tid", "source", F.floor(F.col("rank") / block_rows).alias("block"), (F.col("rank") % block_rows).cast("int").alias("place"))
    timed = placed.join(F.broadcast(slots) if sum(blocks.values()) <= BROADCAST_ROWS else slots, ["source", "block"])
    return timed.select("doc_id", "tid", "source", "block", "slot", "place")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs in the schedule's order: partitions, and rows in them, ascend by slot and place. All rows and columns are kept."""
    order = saved(schedule(docs, weights), "schedule").groupBy(F.col("doc_id").alias("_d"), F.col("tid").alias("_t")).agg(F.min(F.struct("slot", "place")).alias("_at"))
    joined = docs.join(order, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t")))
    return joined.repartitionByRange(F.col("_at.slot"), F.col("_at.place")).sortWithinPartitions("_at.slot", "_at.place").select(*(docs[c] for c in docs.columns))
