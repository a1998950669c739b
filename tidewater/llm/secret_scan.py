"""Secret scan over a ledger of content-addressed blobs.

Every version of a file is named by the SHA-256 of its text. A ledger, partitioned by rule version, holds one row for
each blob scanned under that version, with its findings. A scan reads the names of all versions, keeps blobs the ledger
lacks for the rule version, scans each once however many paths hold it, appends them, and joins findings back to every path.

Only DataFrame functions: a kind's matches and the gaps between them come from one pattern, and running lengths of
both give the offsets. Null texts count as empty. Rows that share a key are all kept. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import new_path, saved

RULE_VERSION = 1
#: Kind, pattern, the group whose length counts, and the least length. A run of the hex and access
#: alphabets is taken whole, so its least length can stand in the pattern.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
FINDINGS = "array<struct<start:bigint,kind:string,end:bigint>>"


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The kind's matches in order: matched text, length that counts, and length of the gap before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.transform(found, F.char_length).alias("size"), F.transform(counts, F.char_length).alias("counts"), F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(found)).alias("gap"))
    return F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), x["size"].cast("bigint").alias("size"), x["counts"].alias("counts"), x["gap"].cast("bigint").alias("gap")))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, text to blob, findings: one row for each blob with findings, ordered by start, then by kind as listed.

    A blob must have one row: offsets are running lengths over a blob's matches.
    """
    none = F.lit(None).cast("array<struct<kind:string,size:bigint,counts:int,gap:bigint>>")
    parts = [F.when(F.col("text").rlike(pattern), _matches(F.col("text"), kind, pattern, group)).otherwise(none) for kind, pattern, group, _ in RULES]
    hits = blobs.filter(F.col("text").rlike("|".join(f"(?:{pattern})" for _, pattern, _, _ in RULES)))
    rows = hits.select("blob", F.posexplode(F.flatten(F.array_compact(F.array(*parts)))).alias("at", "m"))
    so_far = Window.partitionBy("blob", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("blob", F.col("m.kind").alias("kind"), F.col("m.size").alias("size"), F.col("m.counts").alias("counts"), F.sum(F.col("m.size") + F.col("m.gap")).over(so_far).alias("end"))
    least = F.element_at(F.create_map(*(F.lit(x) for kind, _, _, n in RULES for x in (kind, n))), F.col("kind"))
    order = F.element_at(F.create_map(*(F.lit(x) for i, (kind, *_) in enumerate(RULES) for x in (kind, i))), F.col("kind"))
    kept = ends.filter(F.col("counts") >= least).select("blob", F.struct((F.col("end") - F.col("size")).alias("start"), order.alias("order"), "kind", "end").alias("f"))
    found = kept.groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("f"))
    return found.select("blob", F.transform("f", lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"))).alias("findings"))


def update_ledger(versions: DataFrame, key: str, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan the blobs of `versions` (key, text) that the ledger at path `ledger` lacks, and append them.

    Returns the versions' names: key, blob, written once.
    """
    spark = versions.sparkSession
    text = F.coalesce("text", F.lit(""))
    names = saved(versions.select(F.col(key), F.sha2(text, 256).alias("blob")), "versions")
    known = read_ledger(spark, ledger).filter(F.col("rule_version") == rule_version).select("blob")
    # which of a blob's versions is read does not matter: their texts are the same
    unseen = names.filter(F.col(key).isNotNull()).groupBy("blob").agg(F.min(key).alias(key)).join(known, "blob", "left_anti")
    nameless = versions.filter(F.col(key).isNull()).select(F.sha2(text, 256).alias("blob"), text.alias("text")).filter(F.length("text") > 0).join(known, "blob", "left_anti")
    texts = versions.select(F.col(key), text.alias("text")).filter(F.length("text") > 0)
    fetched = unseen.join(texts, key).filter(F.col("blob") == F.sha2("text", 256)).select("blob", "text")
    # rows that share key and text, or lack a key, can give a blob more than once
    found = scan_blobs(fetched.unionByName(nameless).dropDuplicates(["blob"]))
    scanned = names.select("blob").distinct().join(known, "blob", "left_anti")
    rows = scanned.join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("findings", F.array().cast(FINDINGS)).cast(FINDINGS).alias("findings"))
    rows.write.mode("append").partitionBy("rule_version").parquet(ledger)
    return names


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows, one for each blob and rule version, also where a scan was run again; none where it does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    schema = f"blob string, findings {FINDINGS}, rule_version int"
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(ledger).dropDuplicates(["blob", "rule_version"])
    return spark.createDataFrame([], schema)


def scan_versions(versions: DataFrame, key: str = "doc_id", ledger: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """key, blob, findings for every version, scanning what the ledger lacks; a ledger of its own if none is given."""
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    names = update_ledger(versions, key, ledger, rule_version)
    hits = read_ledger(spark, ledger).filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    return names.join(hits, "blob", "left").select(key, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan_versions(docs, "doc_id")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    counts = [F.array_size(F.filter(F.col("findings.kind"), F.lit(kind).eqNullSafe)).cast("bigint").alias(f"n_{kind}") for kind, *_ in RULES]
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
