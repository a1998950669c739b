"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item is cut into windows of `size` words (an item of fewer, but not none, is one window). A window can only
occur where all its word shingles do, so one of them suffices to find it: shingles are ordered by how rare they are in
the documents, and each window is joined through its rarest one. The shingle's place gives the only possible start;
starts before the text, or too near its end for the window's length, are dropped, and what is left is compared word by
word with the item-sized slice of the document.

Documents are read twice: once for the places of benchmark shingles (a small table, from which rarity is counted and
candidates are joined), and again for the texts of documents with candidates. Only DataFrame functions.

Null texts and texts without words have no words and no hits. Rows are told apart by (doc_id, text): repeated rows are
all kept, with equal results. A null doc_id is kept. Other columns are left out. An empty benchmark hits nothing. Null
item_ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import maybe_broadcast, saved, small

WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a shingle, where the window has as many.
SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))


def shingle_hashes(lowered: str, n: int) -> Column:
    """Hashes of the column's shingles of n words, in order; none if it has fewer words."""
    column = F.col(lowered)
    starts = F.slice(column, 1, F.greatest(F.size(column) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(column, i + k) for k in range(1, n))))


def plain(words_of: Column) -> Column:
    """Words joined by a blank, with A-Z in lower case."""
    return F.translate(F.array_join(words_of, " "), UPPER, LOWER)


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, window (its words joined by a blank), length: all windows of all items."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("w"))
    return cut.select("item_id", plain(F.col("w")).alias("window"), F.size("w").alias("length"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, length, n, at, shingle: the shingles of each distinct window, of n words each."""
    # as in documents, hashes are of fully lower-cased words: equal words give equal hashes, and the comparison decides
    distinct = windows.select("window", "length").distinct().withColumn("l", F.split(F.lower("window"), " "))
    parts = [distinct.filter(F.col("length") >= n if n == SHINGLE else F.col("length") == n).select("window", "length", F.lit(n).alias("n"), F.posexplode(shingle_hashes("l", n)).alias("at", "shingle")) for n in range(1, SHINGLE + 1)]
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


def occurrences(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """doc_id, tid, n_words, n, place, shingle: where documents hold benchmark shingles."""
    lowered = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.transform(words("text"), F.lower).alias("l"))
    sized = lowered.withColumn("n_words", F.size("l"))
    found = None
    for n in [r["n"] for r in shingles.select("n").distinct().collect()]:
        wanted = maybe_broadcast(shingles.filter(F.col("n") == n).select("shingle").distinct())
        placed = sized.select("doc_id", "tid", "n_words", F.lit(n).alias("n"), F.posexplode(shingle_hashes("l", n)).alias("place", "shingle"))
        part = placed.join(wanted, "shingle")
        found = part if found is None else found.unionByName(part)
    return found


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences (doc_id, tid, start, length, window), and the windows of items (item_id, window, length)."""
    windows = saved(windows_of(benchmark, size), "windows")
    shingles = saved(window_shingles(windows), "window-shingles")
    if shingles.isEmpty():
        none = docs.limit(0).select("doc_id", F.lit(0).cast("bigint").alias("tid"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window"))
        return none, windows
    places = saved(occurrences(docs, shingles), "places")
    rarity = places.groupBy("n", "shingle").agg(F.count(F.lit(1)).alias("rows"))
    # an inner join: a window with a shingle that no document holds occurs nowhere
    ranked = shingles.join(rarity, ["n", "shingle"], "left").groupBy("window", "length", "n").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "at", "shingle")).alias("rarest"))
    prefixes = ranked.filter(F.col("rarest.rows") > 0).select("window", "length", "n", F.col("rarest.at").alias("at"), F.col("rarest.shingle").alias("shingle"))
    start = F.col("place") - F.col("at")
    possible = places.join(maybe_broadcast(prefixes), ["n", "shingle"]).filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    per_doc = possible.groupBy("doc_id", "tid").agg(F.collect_set(F.struct(start.alias("start"), "length", "window")).alias("possible"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    # repeated rows are one here; the bound is on candidates, since a row of per_doc holds any number of them
    per_doc = F.broadcast(per_doc) if small(possible) else per_doc.hint("shuffle_hash")
    both = texts.withColumnsRenamed({"doc_id": "d", "tid": "t"}).join(per_doc, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid"))).withColumn("w", words("text"))
    right = F.filter("possible", lambda p: plain(F.slice(F.col("w"), p["start"] + 1, p["length"])) == p["window"])
    hits = both.select("doc_id", "tid", F.explode(right).alias("p")).select("doc_id", "tid", "p.*")
    return hits, windows


def decontamination_report(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, tid, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    hits, windows = contaminated_words(docs, benchmark, size)
    hits = saved(hits, "hits")
    spans = hits.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    # words in the union of spans ordered by start: each adds what lies beyond the furthest end so far
    union = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(s["end"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n")), lambda a: a["n"].cast("bigint"))
    items = hits.select("doc_id", "tid", "window").distinct().join(maybe_broadcast(windows.select("item_id", "window").distinct()), "window")
    items = items.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = spans.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), union.alias("n_hit")).join(items, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid"))).select("d", "t", "n_hit", "items")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("bigint")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("tid"), n_words.alias("n_words"))
    joined = all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select("doc_id", "tid", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs without contaminated rows; all columns kept."""
    bad = decontamination_report(docs, benchmark, size).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("tid").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t")), "left_anti")
