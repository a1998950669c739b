"""Search for parts of texts by an inverted table of trigrams.

The index has a row for each trigram and document, sorted by trigram within partitions of its hash. A search reads the rows of its
rarest trigrams alone, keeps the documents that have all of them, and looks only into their texts. Patterns without three
characters in a row, which no trigram can find, are looked for in all texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.catalog import containing
from tidewater.workspace import saved

PARTS = 64
#: Trigrams of a pattern that are looked up: the rarest of it.
LOOKED_UP = 4
#: Up to so many candidates are named in the filter of the texts' scan; more are joined.
NAMED = 1000


def trigrams(text: Column) -> Column:
    """The different trigrams of a text in lower case. Characters are split once, so that long texts take time in proportion."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.array_distinct(F.transform(F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))).alias("b"), F.slice(chars, 3, F.greatest(F.size(chars) - 2, F.lit(0))).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"])))


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def build_index(docs: DataFrame, path: str, key: str = "id", text: str = "text_content", parts: int = PARTS) -> str:
    """Write the index of docs: postings, and the number of documents of each trigram."""
    rows = docs.select(F.col(key).alias("id"), F.explode(trigrams(F.col(text))).alias("gram")).filter(F.col("gram").isNotNull()).withColumn("part", _part(F.col("gram"), parts))
    # dealt by document too, so that a trigram which most texts have is no single task
    dealt = rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("part", "gram", "id")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    counts = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts")
    return path


def pattern_trigrams(pattern: str) -> list[str]:
    """Trigrams that every text with the pattern has: those between its wildcards and escaped characters."""
    pieces = re.split(r"\\.?|[%_]", pattern.lower(), flags=re.DOTALL)
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def candidates(spark: SparkSession, index: str, pattern: str, parts: int = PARTS) -> DataFrame | None:
    """id of the documents that have the pattern's rarest trigrams; None if it has none."""
    grams = pattern_trigrams(pattern)
    if not grams:
        return None
    named = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _part(F.col("gram"), parts).alias("part")).collect()
    mine = lambda df, found: df.filter(F.col("part").isin(sorted({r["part"] for r in found})) & F.col("gram").isin([r["gram"] for r in found]))
    counts = {r["gram"]: r["n"] for r in mine(spark.read.parquet(f"{index}/counts"), named).collect()}
    if len(counts) < len(grams):  # a trigram that no text has
        return spark.createDataFrame([], spark.read.parquet(f"{index}/postings").select("id").schema)
    rarest = sorted(named, key=lambda r: (counts[r["gram"]], r["gram"]))[:LOOKED_UP]
    postings = mine(spark.read.parquet(f"{index}/postings"), rarest)
    return postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select("id")


def indexed(docs: DataFrame, index: str, pattern: str, key: str = "id", text: str = "text_content", parts: int = PARTS) -> DataFrame:
    """The rows of docs whose text contains the pattern (% and _ are wildcards, case does not count), by the index."""
    found = candidates(docs.sparkSession, index, pattern, parts)
    if found is None:
        return docs.filter(containing(text, pattern))
    found = saved(found, "candidates")
    few = [r["id"] for r in found.limit(NAMED + 1).collect()]
    here = docs.filter(F.col(key).isin(few)) if len(few) <= NAMED else docs.join(found.withColumnRenamed("id", key), key, "left_semi")
    return here.filter(containing(text, pattern))
