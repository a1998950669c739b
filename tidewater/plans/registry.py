"""Registered queries: one for each operator, over whole tables, with the DuckDB SQL that gives the same rows.

Views of tidewater.plans.views that the SQL names are put in front of it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.functions.images import bitmap
from tidewater.operators import assemble as asm
from tidewater.operators import catalog as cat
from tidewater.operators import clean as cl
from tidewater.operators import infer as inf
from tidewater.operators import merge as mg
from tidewater.operators import search as se
from tidewater.plans import extraction as ex
from tidewater.plans import pipelines as pl
from tidewater.plans import tables as tb
from tidewater.plans import views as v
from tidewater.sources import files as src
from tidewater.sources import objects as ob
from tidewater.sources import writers as wr
from tidewater.streaming import ingest as st
from tidewater.workspace import new_path, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF, NOW = v.AS_OF, "2024-02-01 00:00:00"
W = r"[^\p{L}\p{N}_]"


def query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        used = [k for k in v.SQL if re.search(rf"\b{k}\b", sql)]
        ORACLE_SQL[name] = (f"WITH {', '.join(f'{k} AS ({v.SQL[k]})' for k in used)} " if used else "") + sql


def over(view: Callable, change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: change(view(spark, d))


def _table_name(spark: SparkSession, name: str) -> str:
    return f"{name}_{new_path(spark, 't').rsplit('-', 1)[1]}"


# --- sources -------------------------------------------------------------------------------------------------------


KEY = "concat('raw/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt')"
#: The given documents as objects; those without text have no bytes and are not listed.
OBJECTS = f"(SELECT doc_id, source, text, {KEY} AS object_name, strlen(text) AS length, sha256(text) AS content_hash FROM documents WHERE strlen(text) > 0)"


def put_documents(spark: SparkSession, d: str, base: str, condition: str = "true") -> str:
    """Documents as text objects raw/<source>/<id>.txt under base; the folder raw."""
    rows = v.table(spark, d, "documents").filter(condition).selectExpr(f"{KEY} AS key", "text AS content")
    return f"{ob.put_objects(rows.repartition('key'), base)}/raw"


def _landed(spark: SparkSession, d: str) -> str:
    return put_documents(spark, d, new_path(spark, "landing"))


def s1_landing(spark: SparkSession, d: str) -> DataFrame:
    return src.landing(spark, _landed(spark, d)).select(st.object_name(F.col("path")).alias("object_name"), "length")


def s2_objects(spark: SparkSession, d: str) -> DataFrame:
    text = src.decoded(F.col("content"))
    return src.objects(spark, _landed(spark, d)).select(st.object_name(F.col("path")).alias("object_name"), F.sha2("content", 256).alias("content_hash"), F.regexp_count(text, F.lit("\n")).cast("bigint").alias("n_lines"), F.char_length(text).cast("bigint").alias("n_chars"))


def s3_plain_csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    v.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.csv(path, header=True)
    return src.plain_csv(spark, path).select(F.col("p_partkey").cast("bigint"), "p_name", "p_brand", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"))


def s4_tolerant_csv(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines, some with a field too many or too few."""
    path = new_path(spark, "ragged")
    key = F.col("o_orderkey").cast("string")
    whole = F.concat_ws(",", key, "o_orderstatus", "o_orderpriority")
    quoted = F.concat_ws(",", key, F.concat(F.lit('"'), "o_orderstatus", F.lit(', ""so""\n"')), "o_orderpriority")
    over = F.when(F.col("o_orderkey") % 2 == 0, F.concat(whole, F.lit(","))).otherwise(F.concat(whole, F.lit(",x")))
    line = F.when(F.col("o_orderkey") % 7 == 0, key).when(F.col("o_orderkey") % 11 == 0, over).when(F.col("o_orderkey") % 13 == 0, quoted).otherwise(whole)
    head = F.lit("o_orderkey,o_orderstatus,o_orderpriority")
    orders = v.table(spark, d, "orders").select(line.alias("value"))
    # a header in every file: one line before each partition's first
    numbered = orders.withColumn("first", F.monotonically_increasing_id() % (1 << 33) == 0)
    numbered.select(F.explode(F.when(F.col("first"), F.array(head, "value")).otherwise(F.array("value"))).alias("value")).write.text(path)
    return src.tolerant_csv(spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


def s5_any_json(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of JSON, some of them broken, beside documents that run over lines, each an array of a few events."""
    path = new_path(spark, "json")
    good = F.to_json(F.struct("event_id", "event_type", F.struct("user_id", "value").alias("by")))
    line = F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(good)
    events = v.table(spark, d, "events")
    events.filter("event_id % 10 <> 3").select(line.alias("value")).write.text(f"{path}/lines")
    arrays = events.filter("event_id % 10 = 3").groupBy(F.floor(F.col("event_id") / 2000).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(good), ",\n"), F.lit("\n]")).alias("value"))
    arrays.repartition("file").write.partitionBy("file").text(f"{path}/documents")
    read = cl.flattened(src.any_json(spark, [f"{path}/lines", f"{path}/documents/*"]))
    return read.filter(F.col("event_id").isNotNull()).select("event_id", "event_type", F.col("`by.user_id`").alias("by_user_id"), F.col("`by.value`").alias("by_value"))


def s9_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes, those in some languages in another encoding."""
    content = F.when(F.col("lang") == "de", F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    files = v.table(spark, d, "documents").select("doc_id", content.alias("content"))
    return files.select("doc_id", src.encoding(F.col("content")).alias("encoding"), F.char_length(src.decoded(F.col("content"))).alias("n_chars"))


query("s1_landing", s1_landing, f"SELECT object_name, length FROM {OBJECTS}")
query("s2_objects", s2_objects, f"SELECT object_name, content_hash, length(text) - length(replace(text, chr(10), '')) AS n_lines, length(text) AS n_chars FROM {OBJECTS}")
query("s3_plain_csv", s3_plain_csv, "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
query("s4_tolerant_csv", s4_tolerant_csv, "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN concat(o_orderstatus, ', \"so\"', chr(10)) ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 <> 0")
query("s5_any_json", s5_any_json, "SELECT event_id, event_type, user_id AS by_user_id, value AS by_value FROM events WHERE event_id % 50 <> 0")
query("s6_parquet", lambda spark, d: v.table(spark, d, "supplier"), "SELECT * FROM supplier")
query("s7_drop_folder", lambda spark, d: src.drop_folder(spark, _landed(spark, d)).drop("path"), f"SELECT 'lake' AS bucket_name, concat('raw/', CAST(doc_id AS VARCHAR), '.txt') AS object_name, length AS object_size, 'txt' AS file_format FROM {OBJECTS}")
query("s8_file_type", over(v.catalog, lambda c: c.select("catalog_id", src.file_type(F.col("object_name"), F.col("metadata")).alias("file_type"))), "SELECT catalog_id, CASE WHEN object_name LIKE '%.csv' THEN 'csv' WHEN json_valid(left(metadata, 1000)) THEN 'json' ELSE 'csv' END AS file_type FROM catalog_v")
query("s9_encoding", s9_encoding, "SELECT doc_id, CASE WHEN lang = 'de' AND regexp_matches(text, '[\\x{80}-\\x{FF}]') THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
query(
    "s10_delimiter",
    over(v.docs, lambda x: src.delimiters(x, "id", "text_content")),
    """SELECT id, delimiter FROM (SELECT id, delimiter, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS r FROM (
    SELECT id, k, CASE WHEN score > 0 THEN delimiter ELSE ',' END AS delimiter, score FROM (
      SELECT id, c.k, c.delimiter, CASE WHEN len(lines) = 0 THEN 0.0 ELSE list_avg(n) / (1 + list_var_pop(n)) END AS score
      FROM (SELECT id, list_filter(string_split(left(text_content, 5000), chr(10))[1:10], lambda x: trim(x, ' ') <> '') AS lines FROM docs_v) d
      CROSS JOIN (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|'), (4, ':')) AS c(k, delimiter)
      CROSS JOIN LATERAL (SELECT list_transform(d.lines, lambda x: CAST(length(x) - length(replace(x, c.delimiter, '')) AS DOUBLE)) AS n) q))) WHERE r = 1""",
)
query("s12_scan", over(v.catalog, lambda c: c.select("catalog_id", "object_name", "file_format")), "SELECT catalog_id, object_name, file_format FROM catalog_v")

# --- sinks ---------------------------------------------------------------------------------------------------------


def k1_parquet(spark: SparkSession, d: str) -> DataFrame:
    made = v.table(spark, d, "events").select("event_id", F.array("event_type").alias("kinds"), F.struct("user_id").alias("by"))
    return spark.read.parquet(wr.write_parquet(made, new_path(spark, "k1")))


def k3_replace(spark: SparkSession, d: str) -> DataFrame:
    """The typed load, read back; times as text."""
    name = wr.load_typed(cl.clean_frame(v.dirty(spark, d)), _table_name(spark, "typed"), new_path(spark, "k3"))
    return spark.table(name).select("int_col", "big_col", F.col("num_col").cast("double"), F.to_date("date_col").alias("date_col"), F.col("bool_col"), "text_col")


def k3_kept(spark: SparkSession, d: str) -> DataFrame:
    """A table after a load, after one that fails midway, and after a load of other rows with other columns."""
    name, path = _table_name(spark, "kept"), new_path(spark, "k3")
    rows = v.table(spark, d, "supplier")
    wr.replace_table(rows.filter("s_suppkey % 2 = 0"), name, path)
    bad = rows.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 5 == 3, F.raise_error(F.lit("a row fails"))).otherwise(F.col("s_nationkey")).cast(rows.schema["s_nationkey"].dataType))
    try:
        wr.replace_table(bad, name, path)
        raise AssertionError("the load should fail")
    except PySparkException:
        pass
    after = saved(spark.table(name).select("s_suppkey", "s_name", F.lit("failed").alias("load")), "after")
    wr.replace_table(rows.filter("s_suppkey % 2 = 1").withColumn("extra", F.lit(1)), name, path)
    return after.unionByName(spark.table(name).filter("extra = 1").select("s_suppkey", "s_name", F.lit("replaced").alias("load")))


def k6_tables_csv(spark: SparkSession, d: str) -> DataFrame:
    """Extracted tables as CSV objects under their keys."""
    data = saved(asm.promoted(asm.padded(v.cells(spark, d))), "data")
    texts = asm.csv_texts(data).join(asm.table_keys(v.cells(spark, d), "report"), "table_no")
    base = wr.put_tables(texts, new_path(spark, "k6"))
    return ob.listed(spark, base, contents=True).select("key", "length", F.sha2("content", 256).alias("content_hash"))


def k7_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as objects named after their files."""
    texts = v.docs(spark, d).select("object_name", F.col("text_content").alias("text"))
    base = wr.put_texts(texts.repartition("object_name"), new_path(spark, "k7"))
    return ob.listed(spark, base, contents=True).select("key", "length", F.sha2("content", 256).alias("content_hash"))


def k8_slide_json(spark: SparkSession, d: str) -> DataFrame:
    """Slides as JSON objects, read back by their fields."""
    decks = asm.slides(v.units(spark, d)).withColumn("object_name", F.concat(F.lit("raw/"), F.col("doc_no").cast("string"), F.lit(".pptx")))
    base = wr.put_decks(decks, new_path(spark, "k8"))
    read = F.from_json(F.decode("content", "UTF-8"), "title string, body array<string>, notes string")
    return ob.listed(spark, base, contents=True).select("key", read.alias("j")).select("key", "j.title", F.array_join("j.body", "|").alias("body"), "j.notes")


def k9_archive(spark: SparkSession, d: str) -> DataFrame:
    """The archive after the same objects were archived twice."""
    landed, base = _landed(spark, d), new_path(spark, "k9")
    for _ in range(2):
        wr.archive(ob.listed(spark, landed, contents=True), base, AS_OF)
    return ob.listed(spark, base, contents=True).select("key", "length", F.sha2("content", 256).alias("content_hash"))


DIRTY_CLEAN = """SELECT int_col, big_col, CASE WHEN trim(num_col) = 'N/A' THEN NULL ELSE trim(num_col) END AS num_col, date_col, bool_col, json_col, CASE WHEN trim(text_col) = 'NULL' THEN NULL ELSE trim(text_col) END AS text_col, empty_col FROM dirty_v WHERE int_col IS NOT NULL"""
query("k1_parquet", k1_parquet, "SELECT event_id, concat('[\"', event_type, '\"]') AS kinds, concat('{\"user_id\":', CAST(user_id AS VARCHAR), '}') AS \"by\" FROM events")
query("k2_plain_parquet", lambda spark, d: spark.read.parquet(wr.write_parquet(v.table(spark, d, "customer"), new_path(spark, "k2"))), "SELECT * FROM customer")
query("k3_typed_load", k3_replace, f"SELECT CAST(int_col AS INT) AS int_col, CAST(big_col AS BIGINT) AS big_col, CAST(num_col AS DOUBLE) AS num_col, CAST(date_col AS DATE) AS date_col, (bool_col = 'Yes') AS bool_col, text_col FROM ({DIRTY_CLEAN})")
query("k4_text_load", lambda spark, d: spark.table(wr.load_text(v.table(spark, d, "nation"), _table_name(spark, "texts"), new_path(spark, "k4"))).select("n_nationkey", "n_name", "n_regionkey"), "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
query("k5_simple_load", lambda spark, d: spark.table(wr.load_simple(v.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), _table_name(spark, "simple"), new_path(spark, "k5"))).withColumn("p_retailprice", F.col("p_retailprice").cast("double")), "SELECT CAST(p_partkey AS INT) AS p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS p_retailprice FROM part")
query("k3_kept_table", k3_kept, "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'failed' ELSE 'replaced' END AS load FROM supplier")
CSV = """SELECT table_no, concat({head}, chr(10), string_agg(line, chr(10) ORDER BY row_no), chr(10)) AS content, count(*) AS n_rows FROM (SELECT table_no, row_no, string_agg(CASE WHEN regexp_matches(value, '[,"\r\n]') THEN concat('"', replace(value, '"', '""'), '"') ELSE coalesce(value, '') END, ',' ORDER BY col_no) AS line FROM ({cells}) GROUP BY table_no, row_no) {names} GROUP BY table_no"""
query("k6_tables_csv", k6_tables_csv, f"SELECT concat('report_table_', CAST(table_no + 1 AS VARCHAR), '.csv') AS key, strlen(content) AS length, sha256(content) AS content_hash FROM ({CSV.format(head="'part_key,name,name_1,unnamed_column'", names='', cells='SELECT table_no, row_no, col_no, text AS value FROM cells_v WHERE row_no > 0 AND col_no < 3 UNION ALL SELECT r.table_no, r.row_no, 3, x.text FROM cells_v r LEFT JOIN cells_v x ON x.table_no = r.table_no AND x.row_no = r.row_no AND x.col_no = 3 WHERE r.row_no > 0 AND r.col_no = 0')})")
query("k7_texts", k7_texts, f"SELECT concat('processed/unstructured/text-extracted/', CAST(doc_id AS VARCHAR), '.txt') AS key, length, content_hash FROM {OBJECTS}")
query("k8_slide_json", k8_slide_json, "SELECT concat('processed/unstructured/ppt-structured/', CAST(doc_no AS VARCHAR), '.json') AS key, max_by(text, pos) FILTER (WHERE kind = 'title') AS title, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (WHERE kind = 'body'), '') AS body, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE kind = 'notes'), '') AS notes FROM units_v WHERE trim(text) <> '' GROUP BY doc_no")
query("k9_archive", k9_archive, f"SELECT concat('{AS_OF}/', substring(object_name, 5)) AS key, length, content_hash FROM {OBJECTS}")

# --- projections and filters ---------------------------------------------------------------------------------------

LISTED = ", ".join(cat.LISTED)
query("p1_listing", over(v.catalog, cat.listing), f"SELECT {LISTED} FROM catalog_v")
query("p2_by_key", over(v.catalog, lambda c: c.filter(F.col("catalog_id") == 77)), "SELECT * FROM catalog_v WHERE catalog_id = 77")
query("p3_format", over(v.catalog, lambda c: c.filter(cat.with_format("pdf")).select("catalog_id")), "SELECT catalog_id FROM catalog_v WHERE file_format = 'pdf'")
query("p4_containing", over(v.catalog, lambda c: c.filter(cat.containing("object_name", "FILE 1_0")).select("catalog_id", "object_name")), "SELECT catalog_id, object_name FROM catalog_v WHERE object_name ILIKE '%FILE 1_0%'")
query("p5_raw", over(v.catalog, lambda c: c.filter(F.col("object_name").startswith("raw/")).select("catalog_id")), "SELECT catalog_id FROM catalog_v WHERE object_name LIKE 'raw/%'")
query("p6_same_day", over(v.catalog, lambda c: c.filter(cat.created_on(AS_OF)).select("catalog_id")), f"SELECT catalog_id FROM catalog_v WHERE CAST(created_at AS DATE) = DATE '{AS_OF}'")
query("p7_trailing", over(v.catalog, lambda c: c.filter(cat.created_since(AS_OF, 7)).select("catalog_id")), f"SELECT catalog_id FROM catalog_v WHERE created_at >= DATE '{AS_OF}' - INTERVAL 7 DAY")
query("p8_in_list", over(v.catalog, lambda c: c.filter(F.col("file_format").isin(*cat.TEXT_FORMATS)).select("catalog_id")), "SELECT catalog_id FROM catalog_v WHERE file_format IN ('pdf', 'docx', 'pptx')")
query("p9_not_null", over(v.catalog, lambda c: c.filter(F.col("file_format").isNotNull()).select("catalog_id")), "SELECT catalog_id FROM catalog_v WHERE file_format IS NOT NULL")
query("p10_conjunction", over(v.catalog, lambda c: cat.matching(cat.scoped(c, 7, "user"), "csv", "file").select("catalog_id")), "SELECT catalog_id FROM catalog_v WHERE uploaded_by = 7 AND file_format = 'csv' AND object_name ILIKE '%file%'")
query("p11_scoped", over(v.catalog, lambda c: cat.scoped(c, 7, "user").select("catalog_id", "uploaded_by")), "SELECT catalog_id, uploaded_by FROM catalog_v WHERE uploaded_by = 7")
EXT = "lower(regexp_extract(object_name, '\\.([^.]*)$', 1))"
query("p12_accepted", over(v.catalog, lambda c: cat.classify(c).select("catalog_id", "ext", "accepted")), f"SELECT catalog_id, {EXT} AS ext, {EXT} IN ('csv', 'pdf', 'docx', 'pptx') AS accepted FROM catalog_v")
query("p13_category", over(v.catalog, lambda c: cat.classify(c).select("catalog_id", "category")), f"SELECT catalog_id, CASE {EXT} WHEN 'csv' THEN 'structured' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'ppt' ELSE 'other' END AS category FROM catalog_v")
query("p14_route", over(v.catalog, lambda c: cat.classify(c).select("catalog_id", "route")), f"SELECT catalog_id, CASE {EXT} WHEN 'csv' THEN 'structured' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'ppt' ELSE 'unsupported' END AS route FROM catalog_v")
query("p15_visible_units", over(v.units, asm.visible_units), "SELECT doc_no, pos, kind, text FROM units_v WHERE regexp_replace(text, '\\s', '', 'g') <> ''")
query("p15_whole_tables", over(v.cells, asm.whole_tables), "SELECT * FROM cells_v WHERE table_no IN (SELECT table_no FROM cells_v GROUP BY table_no HAVING max(row_no) > min(row_no))")
query("p16_required", over(v.dirty, lambda x: tb.required(x).select("int_col")), "SELECT int_col FROM dirty_v")
query("p17_display", over(v.catalog, cat.display), "SELECT catalog_id, regexp_extract(object_name, '[^/]*$') AS name, round_even(object_size / 1024.0, 1) AS size_kb, coalesce(file_format, 'unknown') AS format, coalesce(CAST(uploaded_by AS VARCHAR), 'system') AS owner FROM catalog_v")

# --- cleaning ------------------------------------------------------------------------------------------------------


def _named(c: str) -> str:
    marked = f"regexp_replace(trim({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '_', 'g')"
    joined = f"trim(regexp_replace({marked}, '\\s+', '_', 'g'), '_')"
    return f"CASE WHEN {joined} = '' THEN 'unnamed_column' WHEN regexp_matches({joined}, '^[0-9]') THEN lower(concat('col_', {joined})) ELSE lower({joined}) END"


query("t1_column_names", lambda spark, d: v.table(spark, d, "part").select("p_partkey", tx.column_name(F.col("p_name")).alias("name"), tx.column_name(F.concat("p_size", F.lit(" "), "p_type")).alias("led")), f"SELECT p_partkey, {_named('p_name')} AS name, {_named("concat(CAST(p_size AS VARCHAR), ' ', p_type)")} AS led FROM part")
HEADERS = """SELECT table_no, col_no, CASE WHEN n > 1 THEN concat(name, '_', CAST(n - {less} AS VARCHAR)) ELSE name END AS col_name FROM (SELECT table_no, col_no, name, row_number() OVER (PARTITION BY table_no, name ORDER BY col_no) AS n FROM (SELECT table_no, col_no, CASE text WHEN 'Part Key' THEN 'part_key' WHEN 'Name!' THEN 'name' ELSE '{blank}' END AS name FROM cells_v WHERE row_no = 0))"""
query("t2_unique_names", over(v.cells, asm.headers), HEADERS.format(less=1, blank="unnamed_column"))
query("t3_unique_names_from_two", over(v.cells, lambda c: asm.headers(c, 2, "col")), HEADERS.format(less=0, blank="col"))
query("t4_table_names", over(v.catalog, lambda c: c.select("catalog_id", tx.table_name(F.col("object_name")).alias("table_name"))), f"SELECT catalog_id, left(concat('data_', lower(trim(regexp_replace(regexp_replace(regexp_extract(object_name, '[^/]*$'), '\\.[^.]*$', ''), '{W}', '_', 'g'), '_'))), 63) AS table_name FROM catalog_v")
query("t5_drop_empty_rows", over(v.dirty, cl.drop_empty_rows), "SELECT * FROM dirty_v WHERE int_col IS NOT NULL")
query("t6_trim", over(v.dirty, lambda x: cl.trim_all(x)), "SELECT int_col, big_col, trim(num_col) AS num_col, date_col, bool_col, json_col, trim(text_col) AS text_col, empty_col FROM dirty_v")
query("t7_null_tokens", over(v.dirty, lambda x: cl.null_tokens(cl.trim_all(x))), "SELECT int_col, big_col, nullif(trim(num_col), 'N/A') AS num_col, date_col, bool_col, json_col, nullif(trim(text_col), 'NULL') AS text_col, empty_col FROM dirty_v")
query("t8_drop_empty_columns", over(v.dirty, cl.drop_empty_columns), "SELECT int_col, big_col, num_col, date_col, bool_col, json_col, text_col FROM dirty_v")
query("t9_null_blanks", over(v.cells, cl.null_blanks), "SELECT table_no, row_no, col_no, CASE WHEN regexp_full_match(text, '\\s*') THEN NULL ELSE text END AS text FROM cells_v")
query("t10_clean_chain", over(v.dirty, cl.clean_frame), DIRTY_CLEAN)
NORMAL = """SELECT table_no, row_no, col_no, col_name, nullif(trim(text), '') AS value FROM cells_v JOIN ({headers}) h USING (table_no, col_no) WHERE row_no > 0""".format(headers=HEADERS.format(less=1, blank="unnamed_column"))
query("t11_normalise_tables", over(v.cells, lambda c: asm.normalised(asm.promoted(c))), f"SELECT * FROM ({NORMAL}) n WHERE EXISTS (SELECT 1 FROM ({NORMAL}) m WHERE m.table_no = n.table_no AND m.row_no = n.row_no AND m.value IS NOT NULL) AND EXISTS (SELECT 1 FROM ({NORMAL}) m WHERE m.table_no = n.table_no AND m.col_no = n.col_no AND m.value IS NOT NULL)")
query("t12_complex_to_json", lambda spark, d: cl.complex_to_json(v.table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props"))), "SELECT event_id, concat('{\"k\":', CAST(json_extract(props, '$.k') AS VARCHAR), '}') AS props FROM events")
query("t13_flatten", lambda spark, d: cl.clean_names(cl.flattened(v.table(spark, d, "events").select("event_id", F.struct("event_type", F.from_json("props", "k long").alias("props")).alias("e")))), "SELECT event_id, event_type AS e_event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS e_props_k FROM events")


def t13_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of unlike shapes: a field is an object, a number or a text."""
    path = new_path(spark, "mixed")
    inner = F.struct(F.col("user_id").alias("b"), F.struct(F.col("value").cast("decimal(20,2)").alias("d")).alias("c"))
    line = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct("event_id", inner.alias("a"), F.array("event_type").alias("e")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct("event_id", F.col("user_id").alias("a")))).when(F.col("event_id") % 4 == 2, F.to_json(F.struct("event_id", F.struct(F.struct(F.col("event_type").alias("x")).alias("b")).alias("a")))).otherwise("{broken")
    v.table(spark, d, "events").select(line.alias("value")).write.text(path)
    return cl.clean_names(src.flat_json(spark, path)).select("event_id", "a", "a_b", "a_b_x", F.col("a_c_d").cast("double").alias("a_c_d"), F.array_join("e", "|").alias("e"))


query("t13_mixed_records", t13_mixed, "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN user_id END AS a, CASE WHEN event_id % 4 = 0 THEN user_id END AS a_b, CASE WHEN event_id % 4 = 2 THEN event_type END AS a_b_x, CASE WHEN event_id % 4 = 0 THEN CAST(CAST(value AS DECIMAL(20,2)) AS DOUBLE) END AS a_c_d, CASE WHEN event_id % 4 = 0 THEN event_type END AS e FROM events WHERE event_id % 4 < 3")
query("t14_header_row", over(v.cells, asm.promoted), f"SELECT table_no, row_no, col_no, col_name, text AS value FROM cells_v JOIN ({HEADERS.format(less=1, blank='unnamed_column')}) h USING (table_no, col_no) WHERE row_no > 0")
query("t15_generic_headers", over(v.cells, lambda c: asm.headers(c.withColumn("text", F.when((F.col("row_no") > 0) | (F.col("table_no") % 2 == 1), F.col("text"))))), f"SELECT table_no, col_no, CASE WHEN table_no % 2 = 0 THEN concat('column_', CAST(col_no AS VARCHAR)) ELSE col_name END AS col_name FROM ({HEADERS.format(less=1, blank='unnamed_column')})")
query("t16_pad_rows", over(v.cells, asm.padded), "SELECT r.table_no, r.row_no, CAST(c.col_no AS INT) AS col_no, coalesce(x.text, '') AS text FROM (SELECT DISTINCT table_no, row_no FROM cells_v) r CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(col_no) LEFT JOIN cells_v x ON x.table_no = r.table_no AND x.row_no = r.row_no AND x.col_no = c.col_no")
query("t17_nan_to_null", lambda spark, d: cl.nan_to_null(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_quantity").cast("double")).alias("quantity"))), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS quantity FROM lineitem")

# --- inference -----------------------------------------------------------------------------------------------------

query("i1_infer_types", over(v.dirty, lambda x: inf.inferred_table(cl.clean_frame(x))), "SELECT * FROM (VALUES ('int_col', 'INTEGER'), ('big_col', 'BIGINT'), ('num_col', 'NUMERIC'), ('date_col', 'TIMESTAMP'), ('bool_col', 'BOOLEAN'), ('json_col', 'JSONB'), ('text_col', 'TEXT'), ('empty_col', 'TEXT')) AS t(column_name, inferred_type) WHERE EXISTS (SELECT 1 FROM dirty_v WHERE int_col IS NOT NULL)")
query("i2_cast_typed", over(v.dirty, lambda x: inf.cast_typed(cl.clean_frame(x)).select("int_col", "big_col", F.col("num_col").cast("double").alias("num_col"), F.to_date("date_col").alias("date_col"), "bool_col", "json_col", "text_col", "empty_col")), f"SELECT CAST(int_col AS INT) AS int_col, CAST(big_col AS BIGINT) AS big_col, CAST(num_col AS DOUBLE) AS num_col, CAST(date_col AS DATE) AS date_col, (bool_col = 'Yes') AS bool_col, json_col, text_col, empty_col FROM ({DIRTY_CLEAN})")
query("i3_simple_typed", lambda spark, d: inf.simple_typed(v.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")).withColumn("p_retailprice", F.col("p_retailprice").cast("double")), "SELECT CAST(p_partkey AS INT) AS p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS p_retailprice FROM part")
query("i4_profile", over(v.docs, inf.profile), "SELECT count(*) AS row_count, 4 AS column_count, 'id,object_name,file_type,text_content' AS columns, '{\"id\":\"bigint\",\"object_name\":\"string\",\"file_type\":\"string\",\"text_content\":\"string\"}' AS data_types FROM docs_v")

# --- lookups, totals, order ----------------------------------------------------------------------------------------


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return mg.with_content_hash(v.docs(spark, d))


query("j1_new_only", lambda spark, d: mg.new_only(_hashed(spark, d), _hashed(spark, d)).select("id"), "SELECT id FROM docs_v WHERE text_content IN (SELECT text_content FROM docs_v GROUP BY text_content HAVING count(DISTINCT object_name) = 1)")
query("j1_seen_only", lambda spark, d: mg.seen_only(_hashed(spark, d), _hashed(spark, d)).select("id"), "SELECT id FROM docs_v WHERE text_content IN (SELECT text_content FROM docs_v GROUP BY text_content HAVING count(DISTINCT object_name) > 1)")
query("j2_reconcile", lambda spark, d: mg.reconcile(v.catalog(spark, d), v.catalog(spark, d).filter("catalog_id % 3 = 1").select("object_name", F.col("object_size").alias("length"))), 'SELECT c.catalog_id, c.object_name, c.object_size, s.stored_size, s.stored_size IS NOT NULL AS "exists" FROM catalog_v c LEFT JOIN (SELECT object_name, max(object_size) AS stored_size FROM catalog_v WHERE catalog_id % 3 = 1 GROUP BY object_name) s USING (object_name)')
query("j3_owner", lambda spark, d: mg.resolve_owner(v.catalog(spark, d), v.users(spark, d)), "SELECT c.catalog_id, u.id AS uploaded_by, u.username FROM catalog_v c LEFT JOIN users_v u ON u.id = c.uploaded_by")
query("a1_total", over(v.catalog, lambda c: cat.scoped(c, 7, "user").agg(F.count(F.lit(1)).alias("total"))), "SELECT count(*) AS total FROM catalog_v WHERE uploaded_by = 7")
query("a2_created_today", over(v.catalog, lambda c: c.agg(F.count_if(cat.created_on(AS_OF)).alias("today_files"))), f"SELECT count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{AS_OF}') AS today_files FROM catalog_v")
query("a3_raw", over(v.catalog, lambda c: c.agg(F.count_if(F.col("object_name").startswith("raw/")).alias("raw_files"))), "SELECT count(*) FILTER (WHERE object_name LIKE 'raw/%') AS raw_files FROM catalog_v")
query("a4_gigabytes", over(v.catalog, lambda c: c.agg(tx.gigabytes(F.coalesce(F.sum("object_size"), F.lit(0))).alias("total_gb"))), "SELECT round_even(coalesce(sum(object_size), 0) / 1073741824.0, 2) AS total_gb FROM catalog_v")
query("a5_formats", over(v.catalog, cat.formats_count), 'SELECT file_format, count(*) AS "count" FROM catalog_v WHERE file_format IS NOT NULL GROUP BY file_format')
STORAGE = "SELECT file_format, count(*) AS file_count, CAST(sum(object_size) AS BIGINT) AS total_size, avg(object_size) AS avg_size, round_even(sum(object_size) / 1048576.0, 2) AS total_size_mb, round_even(avg(object_size) / 1024.0, 2) AS avg_size_kb FROM catalog_v WHERE file_format IS NOT NULL {scope} GROUP BY file_format"
query("a6_storage_by_format", over(v.catalog, cat.storage_by_format), STORAGE.format(scope=""))
query("a6_storage_of_user", over(v.catalog, lambda c: cat.storage_by_format(cat.scoped(c, 7, "user"))), STORAGE.format(scope="AND uploaded_by = 7"))
query("a7_daily_trend", over(v.catalog, lambda c: cat.daily_trend(c, AS_OF)), f"SELECT CAST(created_at AS DATE) AS \"date\", file_format, count(*) AS \"count\" FROM catalog_v WHERE created_at >= DATE '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2")
query("a8_extraction_rate", over(v.catalog, cat.extraction_rate), "SELECT count(*) AS total, count(*) FILTER (WHERE text_extracted) AS extracted, round_even(100.0 * count(*) FILTER (WHERE text_extracted) / count(*), 2) AS rate FROM catalog_v WHERE file_format IN ('pdf', 'docx', 'pptx')")
query("a9_filtered_total", over(v.catalog, lambda c: cat.matching(c, "csv", "file 1").agg(F.count(F.lit(1)).alias("total"))), "SELECT count(*) AS total FROM catalog_v WHERE file_format = 'csv' AND object_name ILIKE '%file 1%'")
query("a10_dashboard", over(v.catalog, lambda c: cat.dashboard_metrics(c, AS_OF)), f"SELECT count(*) AS total_files, count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{AS_OF}') AS today_files, count(*) FILTER (WHERE object_name LIKE 'raw/%') AS raw_files, round_even(coalesce(sum(object_size), 0) / 1073741824.0, 2) AS total_gb FROM catalog_v")
query("a11_search_count", over(v.docs, lambda x: cat.search_docs(x, "license", None).agg(F.count(F.lit(1)).alias("count"))), "SELECT count(*) AS \"count\" FROM docs_v WHERE text_content ILIKE '%license%'")
query("a12_unit_counters", over(v.units, asm.unit_counters), "SELECT doc_no, count(*) AS n_units, count(*) FILTER (WHERE kind = 'title') AS n_title, count(*) FILTER (WHERE kind = 'body') AS n_body, count(*) FILTER (WHERE kind = 'notes') AS n_notes, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM units_v GROUP BY doc_no")
query("a12_cell_counters", over(v.cells, asm.cell_counters), "SELECT table_no, max(row_no) + 1 AS n_rows, max(col_no) + 1 AS n_columns, count(*) AS n_cells FROM cells_v GROUP BY table_no")
query("l1_page", over(v.catalog, lambda c: cat.files_page(c, 50, 100, None, "file")), f"SELECT {LISTED} FROM catalog_v WHERE object_name ILIKE '%file%' ORDER BY created_at DESC NULLS FIRST, catalog_id DESC LIMIT 50 OFFSET 100")


def l1_seek(spark: SparkSession, d: str) -> DataFrame:
    """Three pages, each from the last row of the one before."""
    pages, last = [], None
    for _ in range(3):
        page = cat.files_after(v.catalog(spark, d), 50, last, None, "file")
        rows = page.select("created_at", "catalog_id").collect()
        pages.append(page)
        last = tuple(rows[-1]) if rows else last
    return reduce(DataFrame.unionByName, pages)


query("l1_seek", l1_seek, f"SELECT {LISTED} FROM catalog_v WHERE object_name ILIKE '%file%' ORDER BY created_at DESC NULLS FIRST, catalog_id DESC LIMIT 150")
query("l2_recent", over(v.catalog, cat.recent_activity), "SELECT catalog_id, object_name, file_format, created_at FROM catalog_v ORDER BY created_at DESC NULLS FIRST, catalog_id DESC LIMIT 5")
query("l3_search", over(v.docs, lambda x: cat.search_docs(x, "license")), "SELECT id, object_name, file_type, left(text_content, 200) AS preview FROM docs_v WHERE text_content ILIKE '%license%' ORDER BY id DESC LIMIT 20")


#: Patterns of the indexed searches: a word, one with wildcards, one that no text has, and one too short for the index.
PATTERNS = ("License", "li_en%ed", "zqxjkvwq", "an")


def l3_indexed(spark: SparkSession, d: str) -> DataFrame:
    """All documents found by each pattern through one index."""
    docs, index = v.docs(spark, d), new_path(spark, "index")
    se.build_index(docs, index, parts=8)
    return reduce(DataFrame.unionByName, (se.indexed(docs, index, p, parts=8).select(F.lit(p).alias("pattern"), "id", "object_name", tx.preview(F.col("text_content")).alias("preview")) for p in PATTERNS))


query("l3_indexed_search", l3_indexed, " UNION ALL ".join(f"SELECT '{p}' AS pattern, id, object_name, left(text_content, 200) AS preview FROM docs_v WHERE text_content ILIKE '%{p}%'" for p in PATTERNS))
query("l4_ordered", over(v.catalog, lambda c: cat.formats_count(c).orderBy("file_format")), 'SELECT file_format, count(*) AS "count" FROM catalog_v WHERE file_format IS NOT NULL GROUP BY file_format ORDER BY file_format')

# --- upserts, ids, duplicates --------------------------------------------------------------------------------------

CATALOG_COLUMNS = ["catalog_id", "bucket_name", "object_name", "object_size", "file_format", "row_count", "text_extracted", "uploaded_by", "created_at", "metadata"]


def _current(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The catalog's first version, and later rows of it as changes: the last of each key."""
    rows = v.catalog(spark, d).select(*CATALOG_COLUMNS).withColumns({"content_hash": F.sha2(F.col("catalog_id").cast("string"), 256), "last_modified": F.lit(None).cast("timestamp_ntz")})
    old, new = rows.filter("catalog_id % 10 < 7"), rows.filter("catalog_id % 10 >= 5")
    first = old.groupBy("bucket_name", "object_name").agg(F.min("catalog_id").alias("catalog_id"))
    return old.join(first, ["bucket_name", "object_name", "catalog_id"], "left_semi"), mg.latest(new, mg.CATALOG_KEYS, ["catalog_id"])


def m1_upsert_catalog(spark: SparkSession, d: str) -> DataFrame:
    return mg.upsert_catalog(*_current(spark, d), NOW).select("catalog_id", "object_name", "object_size", "row_count", "uploaded_by", "created_at", "content_hash", "last_modified")


def m2_touch(spark: SparkSession, d: str) -> DataFrame:
    return mg.touch_catalog(*_current(spark, d), NOW).select("catalog_id", "object_name", "object_size", "row_count", "metadata", "last_modified")


CURRENT = """rows_ AS (SELECT *, sha256(CAST(catalog_id AS VARCHAR)) AS content_hash FROM catalog_v), o AS (SELECT * FROM rows_ WHERE catalog_id IN (SELECT min(catalog_id) FROM rows_ WHERE catalog_id % 10 < 7 GROUP BY object_name)), n AS (SELECT * FROM rows_ WHERE catalog_id IN (SELECT max(catalog_id) FROM rows_ WHERE catalog_id % 10 >= 5 GROUP BY object_name))"""


def _upserted(columns: str) -> str:
    return f"WITH {CURRENT} SELECT coalesce(o.catalog_id, n.catalog_id) AS catalog_id, coalesce(o.object_name, n.object_name) AS object_name, {columns}, CASE WHEN o.catalog_id IS NOT NULL AND n.catalog_id IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_modified FROM o FULL JOIN n ON o.object_name = n.object_name"


def _nested(sql: str) -> str:
    return f"SELECT * FROM ({sql})"


query("m1_upsert_catalog", m1_upsert_catalog, _nested(_upserted("coalesce(n.object_size, o.object_size) AS object_size, coalesce(n.row_count, o.row_count) AS row_count, coalesce(n.uploaded_by, o.uploaded_by) AS uploaded_by, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.content_hash, o.content_hash) AS content_hash")))
query("m2_touch_catalog", m2_touch, _nested(_upserted("coalesce(n.object_size, o.object_size) AS object_size, coalesce(o.row_count, n.row_count) AS row_count, coalesce(n.metadata, o.metadata) AS metadata")))


def m1_stored(spark: SparkSession, d: str) -> DataFrame:
    """The upsert of m1 in a stored catalog: the first version, then the changes, which touch their partitions alone."""
    path = new_path(spark, "catalog")
    first, changes = _current(spark, d)
    schema = ", ".join(f"{c} {t}" for c, t in first.dtypes)
    mg.upsert_stored(spark, path, schema, mg.CATALOG_KEYS, first, lambda current, new: mg.upsert_catalog(current, new, NOW), parts=8)
    mg.upsert_stored(spark, path, schema, mg.CATALOG_KEYS, changes, lambda current, new: mg.upsert_catalog(current, new, NOW), parts=8)
    return mg.stored(spark, path, schema).select("catalog_id", "object_name", "object_size", "row_count", "uploaded_by", "created_at", "content_hash", "last_modified")


query("m1_stored_catalog", m1_stored)
ORACLE_SQL["m1_stored_catalog"] = ORACLE_SQL["m1_upsert_catalog"]


def _doc_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by content: the first row of each, and the last of later ones as changes."""
    rows = _hashed(spark, d)
    old = rows.filter("id % 4 < 3")
    first = old.groupBy("content_hash").agg(F.min("id").alias("id"))
    return old.join(first, ["content_hash", "id"], "left_semi"), mg.latest(rows.filter("id % 4 >= 2"), ["content_hash"], ["id"])


DOC_VERSIONS = "WITH r AS (SELECT *, sha256(text_content) AS content_hash FROM docs_v), o AS (SELECT * FROM r WHERE id IN (SELECT min(id) FROM r WHERE id % 4 < 3 GROUP BY content_hash)), n AS (SELECT * FROM r WHERE id IN (SELECT max(id) FROM r WHERE id % 4 >= 2 GROUP BY content_hash)) SELECT coalesce(o.id, n.id) AS id, content_hash, coalesce(n.object_name, o.object_name) AS object_name, coalesce(n.file_type, o.file_type) AS file_type FROM o FULL JOIN n USING (content_hash)"
query("m3_upsert_documents", lambda spark, d: mg.upsert_documents(*_doc_versions(spark, d)).select("id", "content_hash", "object_name", "file_type"), _nested(DOC_VERSIONS))
query("m4_upsert_images", lambda spark, d: mg.upsert(*_doc_versions(spark, d), ["content_hash"], ["object_name"]).select("id", "content_hash", "object_name"), _nested(DOC_VERSIONS.replace(", coalesce(n.file_type, o.file_type) AS file_type", "")))
query("m5_delete", lambda spark, d: mg.delete_rows(v.catalog(spark, d), v.catalog(spark, d).filter("file_format = 'csv'"), "catalog_id").select("catalog_id"), "SELECT catalog_id FROM catalog_v WHERE file_format IS DISTINCT FROM 'csv'")
query("m6_add_column", over(v.catalog, lambda c: mg.with_column_default(c.select("catalog_id"), "metadata", "{}")), "SELECT catalog_id, '{}' AS metadata FROM catalog_v")


def m7_create(spark: SparkSession, d: str) -> DataFrame:
    """A catalog that was absent, after its first upsert: the last row of each object."""
    empty = tb.create_if_absent(spark, new_path(spark, "catalog"), tb.CATALOG)
    rows = v.catalog(spark, d).withColumns({"content_hash": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("timestamp_ntz")})
    return mg.upsert_catalog(empty, mg.latest(rows, mg.CATALOG_KEYS, ["catalog_id"]), NOW).select("catalog_id", "object_name", "object_size", "uploaded_by", "created_at")


query("m7_create_if_absent", m7_create, "SELECT catalog_id, object_name, object_size, uploaded_by, created_at FROM catalog_v WHERE catalog_id IN (SELECT max(catalog_id) FROM catalog_v GROUP BY object_name)")
query("m8_assign_ids", lambda spark, d: mg.assign_ids(v.table(spark, d, "customer"), ["c_custkey"], 1001), "SELECT *, 1000 + row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
query("h1_content_hash", over(v.docs, lambda x: mg.with_content_hash(x).select("id", "content_hash")), "SELECT id, sha256(text_content) AS content_hash FROM docs_v")
query("h2_dedup_exact", over(v.docs, mg.dedup_exact), "SELECT id, object_name, sha256(text_content) AS content_hash, min(object_name) OVER (PARTITION BY text_content) AS canonical_object, object_name <> min(object_name) OVER (PARTITION BY text_content) AS is_duplicate FROM docs_v")
query("h3_hashed_routes", over(v.catalog, lambda c: cat.classify(c).select("catalog_id", (~F.col("route").isin("structured", "unsupported")).alias("hashed"))), f"SELECT catalog_id, {EXT} IN ('pdf', 'docx', 'pptx') AS hashed FROM catalog_v")

# --- scalar functions ----------------------------------------------------------------------------------------------

NAME = "regexp_extract(object_name, '[^/]*$')"
query(
    "f_paths",
    over(v.catalog, lambda c: c.select("catalog_id", *(f(F.col("object_name")).alias(n) for n, f in (("ext", tx.extension), ("base", tx.basename), ("stem", tx.stem), ("processed", tx.processed_key), ("upload", tx.upload_key))))),
    f"SELECT catalog_id, {EXT} AS ext, {NAME} AS base, regexp_replace({NAME}, '\\.[^.]*$', '') AS stem, regexp_replace(replace(object_name, 'raw/', 'processed/structured/'), '\\.[^.]*$', '.parquet') AS processed, concat('raw/', CASE {EXT} WHEN 'csv' THEN 'structured' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'ppt' ELSE 'other' END, '/', {NAME}) AS upload FROM catalog_v",
)
query("f_table_keys", over(v.cells, lambda c: asm.table_keys(c, "report")), "SELECT DISTINCT table_no, concat('report_table_', CAST(table_no + 1 AS VARCHAR), '.csv') AS table_key FROM cells_v")
query(
    "f_strings",
    over(v.docs, lambda x: x.select("id", tx.preview(F.col("text_content")).alias("preview"), F.lower("file_type").alias("low"), F.char_length("text_content").cast("bigint").alias("chars"), F.octet_length("text_content").cast("bigint").alias("bytes"), F.size(F.split("text_content", "\n")).cast("bigint").alias("lines"), F.regexp_count("text_content", F.lit(",")).cast("bigint").alias("commas"))),
    "SELECT id, left(text_content, 200) AS preview, lower(file_type) AS low, length(text_content) AS chars, CAST(strlen(text_content) AS BIGINT) AS bytes, CAST(len(string_split(text_content, chr(10))) AS BIGINT) AS lines, length(text_content) - length(replace(text_content, ',', '')) AS commas FROM docs_v",
)
query("f_dates", over(v.catalog, lambda c: c.select("catalog_id", F.to_date("created_at").alias("day"), F.date_sub(F.to_date("created_at"), 30).alias("before"), F.date_format("created_at", "yyyy-MM-dd").alias("text"))), "SELECT catalog_id, CAST(created_at AS DATE) AS day, CAST(CAST(created_at AS DATE) - INTERVAL 30 DAY AS DATE) AS before, strftime(created_at, '%Y-%m-%d') AS text FROM catalog_v")
query("f_math", over(v.catalog, lambda c: c.groupBy("file_format").agg(F.avg(tx.kilobytes(F.col("object_size"))).alias("mean_kb"), F.bround(F.var_pop("row_count"), 4).alias("spread"))), "SELECT file_format, avg(round_even(object_size / 1024.0, 2)) AS mean_kb, round_even(var_pop(row_count), 4) AS spread FROM catalog_v GROUP BY file_format")
query("f_json", over(v.catalog, lambda c: c.select("catalog_id", F.from_json("metadata", "k long")["k"].alias("k"), F.col("metadata").rlike(r"^\s*[\[{]").alias("braced"), F.to_json(F.struct(tx.basename(F.col("object_name")).alias("original_filename"), F.lit("api").alias("source"))).alias("made"))), f"SELECT catalog_id, CAST(json_extract(metadata, '$.k') AS BIGINT) AS k, regexp_matches(metadata, '^\\s*[\\[{{]') AS braced, concat('{{\"original_filename\":\"', {NAME}, '\",\"source\":\"api\"}}') AS made FROM catalog_v")


def f_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of each kind, every field from a column."""
    c = v.catalog(spark, d)
    name, owner, day = tx.basename(F.col("object_name")), F.col("uploaded_by").cast("string"), F.date_format("created_at", "yyyy-MM-dd")
    count, size = F.col("row_count"), F.col("object_size")
    common = {"author": owner, "created": day, "modified": day, "title": name, "subject": F.col("file_format"), "category": F.col("bucket_name"), "comments": F.lit('a "b"')}
    kinds = {
        "upload": {"original_filename": name, "mime_type": F.lit("text/csv"), "upload_time": day, "source": F.lit("api_upload")},
        "local": {"original_filename": name, "mime_type": F.lit("text/csv"), "ingest_time": day, "source": F.lit("local_folder")},
        "structured": {"row_count": count, "column_count": F.lit(2), "columns": F.array(F.lit("a"), name), "data_types": F.create_map(F.lit("a"), F.lit("int"))},
        "pdf": {"author": owner, "creator": name, "producer": F.lit("p"), "subject": F.col("file_format"), "title": name, "creation_date": day, "page_count": count, "table_count": size},
        "docx": {**common, "table_count": count, "paragraph_count": size},
        "ppt": {**common, "slide_count": count, "table_count": size, "image_count": F.lit(0)},
        "image": {"width": count, "height": size, "format": F.lit("PNG"), "mode": F.lit("RGB"), "exif": F.map_filter(F.create_map(F.lit("EXIF Model"), name, F.lit("GPS Day"), day, F.lit("Image Make"), owner), lambda k, _: F.contains(k, F.lit("EXIF")) | F.contains(k, F.lit("GPS")))},
    }
    return c.select("catalog_id", *(tx.metadata(k, **fields).alias(k) for k, fields in kinds.items()))


def _json(**fields: str) -> str:
    """DuckDB SQL for JSON text with the fields in order."""
    return "concat('{', " + ", ',', ".join(f"'\"{k}\":', coalesce(CAST(to_json({x}) AS VARCHAR), 'null')" for k, x in fields.items()) + ", '}')"


_DAY, _OWNER = "strftime(created_at, '%Y-%m-%d')", "CAST(uploaded_by AS VARCHAR)"
_COMMON = {"author": _OWNER, "created": _DAY, "modified": _DAY, "title": NAME, "subject": "file_format", "category": "bucket_name", "comments": "'a \"b\"'"}
_METADATA = {
    "upload": _json(original_filename=NAME, mime_type="'text/csv'", upload_time=_DAY, source="'api_upload'"),
    "local": _json(original_filename=NAME, mime_type="'text/csv'", ingest_time=_DAY, source="'local_folder'"),
    "structured": _json(row_count="row_count", column_count="2", columns=f"['a', {NAME}]", data_types="{'a': 'int'}"),
    "pdf": _json(author=_OWNER, creator=NAME, producer="'p'", subject="file_format", title=NAME, creation_date=_DAY, page_count="row_count", table_count="object_size"),
    "docx": _json(**_COMMON, table_count="row_count", paragraph_count="object_size"),
    "ppt": _json(**_COMMON, slide_count="row_count", table_count="object_size", image_count="0"),
    "image": _json(width="row_count", height="object_size", format="'PNG'", mode="'RGB'", exif=f"{{'EXIF Model': {NAME}, 'GPS Day': {_DAY}}}"),
}
query("f_metadata", f_metadata, f"SELECT catalog_id, {', '.join(f'{x} AS {k}' for k, x in _METADATA.items())} FROM catalog_v")
query("f_arrays", over(v.units, lambda u: u.groupBy("doc_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: (x + 1).cast("string")), ",").alias("numbers"), F.max(F.size(F.split("text", " "))).cast("bigint").alias("widest"))), "SELECT doc_no, string_agg(CAST(pos + 1 AS VARCHAR), ',' ORDER BY pos) AS numbers, CAST(max(len(string_split(text, ' '))) AS BIGINT) AS widest FROM units_v GROUP BY doc_no")
query("f_maps", over(v.catalog, lambda c: c.select("catalog_id", tx.category(F.col("file_format")).alias("category"), F.size(F.map_filter(F.create_map(F.lit("a"), F.col("row_count"), F.lit("b"), F.lit(50)), lambda k, x: x > 49)).cast("bigint").alias("large"))), "SELECT catalog_id, CASE file_format WHEN 'csv' THEN 'structured' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'ppt' ELSE 'other' END AS category, CAST(1 + CASE WHEN row_count > 49 THEN 1 ELSE 0 END AS BIGINT) AS large FROM catalog_v")
query("f_conditional", over(v.catalog, lambda c: c.select("catalog_id", F.coalesce("file_format", F.lit("unknown")).alias("format"), F.when(F.col("text_extracted"), 1).otherwise(0).alias("flag"))), "SELECT catalog_id, coalesce(file_format, 'unknown') AS format, CASE WHEN text_extracted THEN 1 ELSE 0 END AS flag FROM catalog_v")


def f_mime(spark: SparkSession, d: str) -> DataFrame:
    """Documents behind the leading bytes of several kinds of files."""
    kinds = {0: "255044462D312E34", 1: "89504E470D0A1A0A", 2: "FFD8FFE0", 3: "504B0304", 4: "504B0304" + b"word/document.xml".hex(), 5: "504B0304" + b"ppt/slides".hex(), 6: "FFFE00"}
    lead = F.lit(b"")
    for i, digits in kinds.items():
        lead = F.when(F.col("doc_id") % 9 == i, F.lit(bytes.fromhex(digits))).otherwise(lead)
    return v.table(spark, d, "documents").select("doc_id", tx.mime_type(F.concat(lead, F.encode("text", "UTF-8"))).alias("mime"))


PACKED = "application/vnd.openxmlformats-officedocument."
query("f_mime", f_mime, f"SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN CASE WHEN contains(text, 'word/') THEN '{PACKED}wordprocessingml.document' WHEN contains(text, 'ppt/') THEN '{PACKED}presentationml.presentation' WHEN contains(text, 'xl/') THEN '{PACKED}spreadsheetml.sheet' ELSE 'application/zip' END WHEN 4 THEN '{PACKED}wordprocessingml.document' WHEN 5 THEN '{PACKED}presentationml.presentation' WHEN 6 THEN 'application/octet-stream' ELSE 'text/plain' END AS mime FROM documents")

# --- documents -----------------------------------------------------------------------------------------------------

VISIBLE = "units_v WHERE regexp_replace(text, '\\s', '', 'g') <> ''"
query("d1_paragraph_text", over(v.units, asm.document_text), f"SELECT doc_no, string_agg(text, chr(10) ORDER BY pos, text) AS text FROM {VISIBLE} GROUP BY doc_no")
query("d2_page_text", over(v.units, asm.page_text), "SELECT doc_no, string_agg(text, '' ORDER BY pos, text) AS text FROM units_v GROUP BY doc_no")
query("d3_slides", over(v.units, lambda u: asm.slides(u).select("doc_no", "title", F.array_join("body", "|").alias("body"), "notes")), f"SELECT doc_no, max_by(text, pos) FILTER (WHERE kind = 'title') AS title, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (WHERE kind = 'body'), '') AS body, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE kind = 'notes'), '') AS notes FROM {VISIBLE} GROUP BY doc_no")
query("d4_deck_text", over(v.units, asm.deck_text), f"SELECT doc_no, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text FROM (SELECT doc_no, pos, CASE kind WHEN 'title' THEN concat('SLIDE ', CAST(pos + 1 AS VARCHAR), ': ', text) WHEN 'notes' THEN concat('Notes: ', text) ELSE text END AS t FROM {VISIBLE}) GROUP BY doc_no")
query("d5_extracted", over(v.docs, lambda x: asm.with_extracted_flag(x).select("id", "text_extracted")), "SELECT id, coalesce(length(trim(text_content)) > 0, false) AS text_extracted FROM docs_v")
query("d6_typed_tables", over(v.cells, asm.typed_tables), f"SELECT table_no, CAST(col_no AS INT) AS col_no, col_name, CASE WHEN count(value) FILTER (WHERE regexp_full_match(value, '[0-9]+')) = count(value) THEN 'INTEGER' ELSE 'TEXT' END AS inferred_type FROM (SELECT table_no, col_no, col_name, value FROM ({NORMAL}) WHERE value IS NOT NULL) GROUP BY 1, 2, 3")
query("d7_document_rows", over(v.docs, lambda x: mg.with_content_hash(x).select("object_name", "file_type", "content_hash")), "SELECT object_name, file_type, sha256(text_content) AS content_hash FROM docs_v")


# --- streams and pipelines -----------------------------------------------------------------------------------------


#: Files that the streams of the queries take at a time.
FILES_AT_A_TIME = 400


def st1_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two landings, each ingested by a run of its own from one checkpoint, then archived: catalog, archive and what is left in landing."""
    base, out, mark, kept = (new_path(spark, x) for x in ("landing", "stream", "mark", "archive"))
    for wave in range(2):
        folder = put_documents(spark, d, base, f"doc_id % 2 = {wave}")
        st.start_ingest(spark, folder, out, mark, archive=kept, files_per_batch=FILES_AT_A_TIME).awaitTermination()
        st.swept(spark, folder, out, mark, kept)
    archived = ob.listed(spark, f"{kept}{ob.store(folder)[1]}", contents=True).select(F.concat(F.lit("raw/"), "key").alias("object_name"), F.col("length").alias("archived_length"), F.sha2("content", 256).alias("archived_hash"))
    left = src.landing(spark, base).select(st.object_name(F.col("path")).alias("object_name"), F.lit(True).alias("left"))
    rows = st.current_catalog(spark, out).join(archived, "object_name", "full_outer").join(left, "object_name", "full_outer")
    return rows.select("object_name", "object_size", "file_format", "route", "content_hash", "archived_length", "archived_hash", F.coalesce("left", F.lit(False)).alias("left_in_landing"))


def st2_drop_folder(spark: SparkSession, d: str) -> DataFrame:
    """The drop folder's stream, upserted into the catalog by key."""
    out, mark, folder = new_path(spark, "stream"), new_path(spark, "mark"), _landed(spark, d)
    st.start_ingest(spark, folder, out, mark, files_per_batch=FILES_AT_A_TIME).awaitTermination()
    landed = st.current_catalog(spark, out).withColumn("metadata", F.lit("{}"))
    empty = spark.createDataFrame([], "catalog_id long, bucket_name string, object_name string, object_size long, metadata string, last_modified timestamp_ntz")
    return mg.touch_catalog(empty, landed, NOW).select("bucket_name", "object_name", "object_size", "metadata")


def st3_new_content(spark: SparkSession, d: str) -> DataFrame:
    """Documents landed in two waves, the second of copies too: each content comes out once."""
    base, out, mark = (new_path(spark, x) for x in ("landing", "stream", "mark"))
    for wave in ("doc_id % 3 = 0", "doc_id % 3 > 0"):
        folder = put_documents(spark, d, base, wave)
        st.start_new_content(spark, folder, out, mark, files_per_batch=FILES_AT_A_TIME).awaitTermination()
    return spark.read.parquet(out).groupBy("content_hash", "object_size").agg(F.count(F.lit(1)).alias("n"))


def _documents_stream(spark: SparkSession, d: str, waves: list[str], between: Callable[[int], None] = lambda number: None) -> tuple[DataFrame, DataFrame]:
    """Stored catalog and documents after landings, each followed by a run of the stream that is started again after failures."""
    base, catalog, documents, mark = (new_path(spark, x) for x in ("landing", "catalog", "documents", "mark"))
    for wave in waves:
        folder = put_documents(spark, d, base, wave)
        st.until_done(lambda folder=folder: st.start_documents(spark, folder, catalog, documents, mark, NOW, files_per_batch=FILES_AT_A_TIME, parts=8, between=between), wait_s=0.1)
    return mg.stored(spark, catalog, tb.CATALOG), mg.stored(spark, documents, tb.DOCUMENTS)


#: Waves in which no content is repeated but those of an earlier one: first copies, second copies, all later ones.
NTH = "doc_id IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM {documents}) WHERE {condition})"


def st5_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First copies, second copies and later ones land in turn: what came first has the text, the others a row without."""
    documents = f"parquet.`{d}/documents.parquet`"
    catalog, texts = _documents_stream(spark, d, [NTH.format(documents=documents, condition=c) for c in ("n = 1", "n = 2", "n > 2")])
    kept = texts.select("content_hash", F.col("object_name").alias("document"), F.sha2("text_content", 256).alias("text_hash"))
    return catalog.join(kept, "content_hash", "left").select("object_name", "object_size", "row_count", "text_extracted", "content_hash", "document", "text_hash")


def st4_replay(spark: SparkSession, d: str) -> DataFrame:
    """Each batch fails once between its two writes, and is made again: the catalog and the documents are those of a run without failures."""
    failed: set[int] = set()

    def between(number: int) -> None:
        if number not in failed and len(failed) < 3:
            failed.add(number)
            raise RuntimeError(f"batch {number} fails between its writes")

    catalog, texts = _documents_stream(spark, d, ["true"], between)
    sums = texts.select("content_hash", F.char_length("text_content").cast("bigint").alias("n_chars"))
    return catalog.groupBy("content_hash").agg(F.count(F.lit(1)).alias("objects"), F.count_if("text_extracted").alias("extracted"), F.sum("object_size").alias("bytes")).join(sums, "content_hash", "left")


def _w1(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The dirty columns and one with letters beyond ASCII, landed with semicolons in another encoding, and their table."""
    path = f"{new_path(spark, 'raw')}/dirty.csv"
    rows = v.dirty(spark, d).withColumn("Other Col!", F.concat(F.lit("né "), "bool_col"))
    rows.write.csv(path, header=True, sep=";", escape='"', encoding="ISO-8859-1")
    return path, pl.structured_file(spark, path, _table_name(spark, "w1"), new_path(spark, "w1"))


def w1_structured(spark: SparkSession, d: str) -> DataFrame:
    return _w1(spark, d)[1].select("int_col", "big_col", F.col("num_col").cast("double").alias("num_col"), F.to_date("date_col").alias("date_col"), "bool_col", "json_col", "text_col", "empty_col", "other_col")


def w1_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after the load of w1."""
    path, made = _w1(spark, d)
    row = pl.structured_row(spark, path, made, "raw/dirty.csv")
    current = v.catalog(spark, d).withColumns({"content_hash": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("timestamp_ntz")})
    out = mg.upsert_catalog(current, row, NOW)
    return out.select("object_name", "row_count", "file_format", (F.col("object_size") > 0).alias("sized"), F.when(F.col("catalog_id").isNull(), F.from_json("metadata", "row_count long, column_count int, columns array<string>")).alias("m")).select("object_name", "row_count", "file_format", "sized", F.array_join("m.columns", ",").alias("columns"), F.col("m.row_count").alias("rows"))


def w7_dispatched(spark: SparkSession, d: str) -> DataFrame:
    """Each route's own frame, put together again."""
    parts = [f.select("catalog_id", F.lit(name).alias("branch")) for name, f in pl.dispatched(v.catalog(spark, d)).items()]
    return reduce(DataFrame.unionByName, parts)


def w6_samples(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    v.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return pl.sample_load(spark, path, _table_name(spark, "w6"), new_path(spark, "w6")).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def _unit_docs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents: their text is that of their first unit."""
    first = v.units(spark, d).groupBy("doc_no").agg(F.min_by("text", "pos").alias("text_content"))
    return first.select(F.col("doc_no").alias("id"), F.format_string("raw/%010d.docx", "doc_no").alias("object_name"), "text_content")


W3_SQL = """WITH d AS (SELECT doc_no, min_by(text, pos) AS first_text, printf('raw/%010d.docx', doc_no) AS object_name FROM units_v GROUP BY doc_no), c AS (SELECT *, min(object_name) OVER (PARTITION BY first_text) AS canonical_object FROM d), t AS (SELECT doc_no, string_agg({unit}, {sep} ORDER BY pos) AS text FROM units_v WHERE trim(text) <> '' GROUP BY doc_no), n AS (SELECT doc_no, count(*) AS n_units, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM units_v GROUP BY doc_no)
SELECT c.doc_no, c.canonical_object, c.object_name <> c.canonical_object AS is_duplicate, CASE WHEN c.object_name = c.canonical_object THEN t.text END AS text, CASE WHEN c.object_name = c.canonical_object THEN n.n_units ELSE 0 END AS n_units, CASE WHEN c.object_name = c.canonical_object THEN n.n_chars ELSE 0 END AS n_chars FROM c LEFT JOIN t USING (doc_no) LEFT JOIN n USING (doc_no)"""
DOC_COLUMNS = ["doc_no", "canonical_object", "is_duplicate", "text", "n_units", "n_chars"]
query("st1_ingest", st1_ingest, f"SELECT object_name, length AS object_size, 'txt' AS file_format, 'unsupported' AS route, content_hash, length AS archived_length, content_hash AS archived_hash, false AS left_in_landing FROM {OBJECTS}")
query("st2_drop_folder", st2_drop_folder, f"SELECT 'lake' AS bucket_name, object_name, length AS object_size, '{{}}' AS metadata FROM {OBJECTS}")
query("st3_new_content", st3_new_content, f"SELECT content_hash, length AS object_size, 1 AS n FROM {OBJECTS} GROUP BY content_hash, length")
query("st4_replay", st4_replay, f"SELECT content_hash, count(*) AS objects, CASE WHEN trim(any_value(text)) <> '' THEN 1 ELSE 0 END AS extracted, CAST(sum(length) AS BIGINT) AS bytes, CASE WHEN trim(any_value(text)) <> '' THEN length(any_value(text)) END AS n_chars FROM {OBJECTS} GROUP BY content_hash")
query("st5_first_seen", st5_first_seen, f"SELECT object_name, length AS object_size, 0 AS row_count, n = 1 AND said AS text_extracted, content_hash, CASE WHEN said THEN first END AS document, CASE WHEN said THEN content_hash END AS text_hash FROM (SELECT *, trim(text) <> '' AS said, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, first_value(object_name) OVER (PARTITION BY text ORDER BY doc_id) AS first FROM {OBJECTS})")
query("w1_structured", w1_structured, f"SELECT CAST(int_col AS INT) AS int_col, CAST(big_col AS BIGINT) AS big_col, CAST(num_col AS DOUBLE) AS num_col, CAST(date_col AS DATE) AS date_col, (bool_col = 'Yes') AS bool_col, json_col, text_col, empty_col, concat('né ', bool_col) AS other_col FROM ({DIRTY_CLEAN})")
query("w1_catalog", w1_catalog, f"SELECT object_name, row_count, file_format, object_size > 0 AS sized, NULL AS columns, NULL AS rows FROM catalog_v UNION ALL SELECT 'raw/dirty.csv', CAST(count(*) AS INT), 'csv', true, 'int_col,big_col,num_col,date_col,bool_col,json_col,text_col,empty_col,other_col', count(*) FROM ({DIRTY_CLEAN})")
query("w7_dispatched", w7_dispatched, f"SELECT catalog_id, CASE {EXT} WHEN 'csv' THEN 'structured' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' ELSE 'ppt' END AS branch FROM catalog_v WHERE {EXT} IN ('csv', 'pdf', 'docx', 'pptx')")
query("w2_tables", over(v.cells, pl.document_tables), f"SELECT t.*, s.n_rows FROM (SELECT table_no, CAST(col_no AS INT) AS col_no, col_name, CASE WHEN count(value) FILTER (WHERE regexp_full_match(value, '[0-9]+')) = count(value) THEN 'INTEGER' ELSE 'TEXT' END AS inferred_type FROM (SELECT table_no, col_no, col_name, value FROM ({NORMAL}) WHERE value IS NOT NULL) GROUP BY 1, 2, 3) t JOIN (SELECT table_no, max(row_no) + 1 AS n_rows FROM cells_v GROUP BY table_no) s USING (table_no)")
query("w3_documents", lambda spark, d: pl.documents(_unit_docs(spark, d), v.units(spark, d)).select(*DOC_COLUMNS), _nested(W3_SQL.format(unit="text", sep="chr(10)")))
query("w3_loaded", lambda spark, d: pl.loaded_documents(spark.createDataFrame([], tb.DOCUMENTS), pl.documents(_unit_docs(spark, d), v.units(spark, d)), NOW).select("object_name", "file_type", "text_content", "content_hash"), _nested(f"SELECT max(object_name) AS object_name, 'docx' AS file_type, text AS text_content, sha256(text) AS content_hash FROM (SELECT printf('raw/%010d.docx', doc_no) AS object_name, text FROM ({W3_SQL.format(unit='text', sep='chr(10)')})) WHERE text <> '' GROUP BY text"))
query("w4_decks", lambda spark, d: pl.documents(_unit_docs(spark, d), v.units(spark, d), slides=True).select(*DOC_COLUMNS), _nested(W3_SQL.format(unit="CASE kind WHEN 'title' THEN concat('SLIDE ', CAST(pos + 1 AS VARCHAR), ': ', text) WHEN 'notes' THEN concat('Notes: ', text) ELSE text END", sep="chr(10) || chr(10)")))
query("w6_samples", w6_samples, "SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS c_acctbal FROM customer")
query("w7_routed", over(v.catalog, pl.routed), _nested(f"WITH t AS (SELECT catalog_id, object_name, CASE {EXT} WHEN 'csv' THEN 'structured' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'ppt' ELSE 'unsupported' END AS route, left(concat('data_', lower(trim(regexp_replace(regexp_replace({NAME}, '\\.[^.]*$', ''), '{W}', '_', 'g'), '_'))), 63) AS table_name FROM catalog_v) SELECT catalog_id, route, table_name, objects FROM t JOIN (SELECT table_name, count(DISTINCT object_name) AS objects FROM t GROUP BY table_name) USING (table_name)"))


# --- documents to the end --------------------------------------------------------------------------------------------


def _varied(cells: DataFrame) -> DataFrame:
    """Cells of tables with unlike columns: other names, numbers with fractions, columns without values."""
    t, row, col = F.col("table_no"), F.col("row_no"), F.col("col_no")
    text = F.when((row == 0) & (col == 2), F.concat(F.lit("Brand "), (t % 4).cast("string"))).when((row > 0) & (col == 1) & (t % 3 == 1), "").when((row > 0) & (col == 0) & (t % 2 == 1), F.concat("text", F.lit(".5"))).otherwise(F.col("text"))
    return cells.withColumn("text", text)


def _lake(spark: SparkSession) -> ex.Lake:
    return ex.Lake(*(new_path(spark, x) for x in ("objects", "tables", "catalog", "documents", "images")), parts=8)


def _processed(spark: SparkSession, d: str, kind: str) -> tuple[ex.Lake, DataFrame]:
    """Conversations as documents of a kind, a part of them in a first run, and the varied tables as theirs."""
    lake, cells, units = _lake(spark), _varied(v.cells(spark, d)), v.units(spark, d)
    docs = _unit_docs(spark, d).select(F.col("id").alias("doc_no"), F.regexp_replace("object_name", "docx$", kind).alias("object_name"), F.octet_length("text_content").cast("long").alias("object_size"), F.sha2("text_content", 256).alias("content_hash"))
    tables = cells.select("table_no").distinct().select("table_no", F.col("table_no").alias("doc_no"), (F.col("table_no") % 3 + 1).alias("place"), (F.col("table_no") % 2 + 1).alias("nth"))
    half = docs.agg(F.max("doc_no")).first()[0] // 2
    runs = [ex.documents(spark, kind, docs.filter(c), units, cells, tables, lake, NOW) for c in (f"doc_no <= {half}", f"doc_no > {half}")]
    return lake, runs[0].unionByName(runs[1])


def _kept(kind: str) -> Query:
    """Catalog rows, objects and documents that are kept of a kind of documents."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        lake = _processed(spark, d, kind)[0]
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        read = F.from_json("metadata", "page_count long, paragraph_count long, slide_count long, table_count long")
        rows = mg.stored(spark, lake.catalog, tb.CATALOG).withColumn("m", read)
        catalog = rows.select(F.lit("catalog").alias("what"), F.col("object_name").alias("name"), F.col("object_size").alias("bytes"), "file_format", "row_count", "text_extracted", "content_hash", F.coalesce("m.page_count", "m.paragraph_count", "m.slide_count").alias("n_units"), F.col("m.table_count").alias("n_tables"))
        found = ob.listed(spark, lake.base, contents=True).filter(~F.col("key").endswith(".json"))
        objects = found.select(F.lit("object").alias("what"), F.col("key").alias("name"), F.col("length").alias("bytes"), none("file_format", "string"), none("row_count", "int"), none("text_extracted", "boolean"), F.sha2("content", 256).alias("content_hash"), none("n_units", "long"), none("n_tables", "long"))
        texts = mg.stored(spark, lake.documents, tb.DOCUMENTS).select(F.lit("document").alias("what"), F.concat("object_name", F.lit(" "), F.sha2("text_content", 256)).alias("name"), F.octet_length("text_content").cast("long").alias("bytes"), F.col("file_type").alias("file_format"), none("row_count", "int"), none("text_extracted", "boolean"), "content_hash", none("n_units", "long"), none("n_tables", "long"))
        return catalog.unionByName(objects).unionByName(texts)

    return run


def d6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """All values of all loaded tables, with the types of their columns."""
    lake, loaded = _processed(spark, d, "pdf")
    kinds = {"int": "INTEGER", "string": "TEXT"}
    parts = []
    for r in loaded.select("signature").distinct().collect():
        table = ex.loaded_tables(spark, lake.tables, r["signature"])
        cells = [F.struct(F.lit(c).alias("col_name"), F.lit(kinds.get(t, "NUMERIC")).alias("kind"), F.col(c).cast("string").alias("value")) for c, t in table.dtypes if c != "table_no"]
        parts.append(table.select(F.col("table_no").cast("long").alias("table_no"), F.inline(F.array(*cells))))
    found = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())
    return found.join(loaded.select("table_no", "table_name"), "table_no")


PROCESSED = """d AS (SELECT doc_no, min_by(text, pos) AS first_text, printf('raw/%010d.{kind}', doc_no) AS object_name FROM units_v GROUP BY doc_no),
f AS (SELECT *, sha256(first_text) AS content_hash, strlen(first_text) AS object_size, object_name = min(object_name) OVER (PARTITION BY first_text) AS kept FROM d),
t AS (SELECT doc_no, object_name, content_hash, string_agg({unit}, {sep} ORDER BY pos) AS text FROM f JOIN units_v USING (doc_no) WHERE kept AND ({visible}) GROUP BY ALL HAVING trim(string_agg({unit}, {sep} ORDER BY pos)) <> ''),
c AS (SELECT table_no, row_no, col_no, nullif(trim(CASE WHEN row_no = 0 AND col_no = 2 THEN concat('Brand ', CAST(table_no % 4 AS VARCHAR)) WHEN row_no > 0 AND col_no = 1 AND table_no % 3 = 1 THEN '' WHEN row_no > 0 AND col_no = 0 AND table_no % 2 = 1 THEN concat(text, '.5') ELSE text END), '') AS value FROM cells_v WHERE table_no IN (SELECT doc_no FROM f WHERE kept)),
g AS (SELECT r.table_no, r.row_no, k.col_no, CASE k.col_no WHEN 0 THEN 'part_key' WHEN 1 THEN 'name' WHEN 2 THEN concat('brand_', CAST(r.table_no % 4 AS VARCHAR)) ELSE 'unnamed_column' END AS col_name, c.value FROM (SELECT DISTINCT table_no, row_no FROM c WHERE row_no > 0) r CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(col_no) LEFT JOIN c ON c.table_no = r.table_no AND c.row_no = r.row_no AND c.col_no = k.col_no),
n AS (SELECT * FROM g WHERE (table_no, col_no) IN (SELECT (table_no, col_no) FROM g WHERE value IS NOT NULL)),
h AS (SELECT table_no, string_agg(col_name, ',' ORDER BY col_no) AS head FROM (SELECT DISTINCT table_no, col_no, col_name FROM n) GROUP BY table_no),
x AS (SELECT *, {key} AS table_key FROM ({csv}))"""
FORMS = {
    "pdf": ("text", "''", "true", "printf('processed/structured/pdf-tables/%010d_page%d_table%d.csv', table_no, table_no % 3 + 1, table_no % 2 + 1)"),
    "docx": ("text", "chr(10)", "trim(text) <> ''", "printf('processed/structured/docx-tables/%010d_table_%d.csv', table_no, table_no % 2 + 1)"),
    "pptx": ("CASE kind WHEN 'title' THEN concat('SLIDE ', CAST(pos + 1 AS VARCHAR), ': ', text) WHEN 'notes' THEN concat('Notes: ', text) ELSE text END", "chr(10) || chr(10)", "trim(text) <> ''", "printf('processed/structured/ppt-tables/%010d_slide%d_table%d.csv', table_no, table_no % 3 + 1, table_no % 2 + 1)"),
}


def _processed_sql(kind: str, sql: str) -> str:
    unit, sep, visible, key = FORMS[kind]
    return f"SELECT * FROM (WITH {PROCESSED.format(kind=kind, unit=unit, sep=sep, visible=visible, key=key, csv=CSV.format(head='any_value(head)', names='JOIN h USING (table_no)', cells='SELECT * FROM n'))} {sql})"


for _n, _kind in (("w2", "pdf"), ("w3", "docx"), ("w4", "pptx")):
    _rows = "coalesce(s.n_rows, 0)" if _kind == "docx" else "coalesce(s.n, 0)"
    query(
        f"{_n}_processed",
        _kept(_kind),
        _processed_sql(
            _kind,
            f"""SELECT 'catalog' AS what, f.object_name AS name, f.object_size AS bytes, '{_kind}' AS file_format, CASE WHEN kept THEN {_rows} ELSE 0 END AS row_count, kept AND t.text IS NOT NULL AS text_extracted, f.content_hash, CASE WHEN kept THEN u.n_units END AS n_units, CASE WHEN kept THEN coalesce(s.n, 0) END AS n_tables FROM f LEFT JOIN t USING (doc_no) LEFT JOIN (SELECT table_no AS doc_no, count(*) AS n, sum(n_rows) AS n_rows FROM x GROUP BY 1) s USING (doc_no) LEFT JOIN (SELECT doc_no, count(*) AS n_units FROM units_v GROUP BY doc_no) u USING (doc_no)
            UNION ALL SELECT 'catalog', table_key, strlen(content), 'csv', n_rows, false, NULL, NULL, NULL FROM x
            UNION ALL SELECT 'object', concat('processed/unstructured/text-extracted/', printf('%010d', doc_no), '.txt'), strlen(text), NULL, NULL, NULL, sha256(text), NULL, NULL FROM t
            UNION ALL SELECT 'object', table_key, strlen(content), NULL, NULL, NULL, sha256(content), NULL, NULL FROM x
            UNION ALL SELECT 'document', concat(object_name, ' ', sha256(text)), strlen(text), '{_kind}', NULL, NULL, content_hash, NULL, NULL FROM t""",
        ),
    )
query("d6_loaded_tables", d6_loaded, _processed_sql("pdf", "SELECT table_no, regexp_replace(concat('data_', regexp_extract(table_key, '[^/]*$')), '[.]csv$', '') AS table_name, col_name, CASE WHEN col_no = 3 OR (col_no = 0 AND table_no % 2 = 0) THEN 'INTEGER' WHEN col_no = 0 THEN 'NUMERIC' ELSE 'TEXT' END AS kind, value FROM n JOIN x USING (table_no) WHERE value IS NOT NULL"))


def w5_images(spark: SparkSession, d: str) -> ex.Lake:
    """Suppliers as bitmaps, landed as objects in two runs: equal sizes and greys are equal images."""
    lake, base = _lake(spark), new_path(spark, "landing")
    key = F.col("s_suppkey")
    made = v.table(spark, d, "supplier").select(F.format_string("raw/%010d.png", "s_suppkey").alias("key"), bitmap(key % 5 + 1, key % 3 + 2, key % 4).alias("content"), "s_suppkey")
    half = made.agg(F.max("s_suppkey")).first()[0] // 2
    for part in (f"s_suppkey <= {half}", f"s_suppkey > {half}"):
        ob.put_objects(made.filter(part), base)
        here = ob.listed(spark, f"{base}/raw", contents=True).withColumn("object_name", F.concat(F.lit("raw/"), "key"))
        ex.images(spark, here, lake, NOW)
    return lake


def w5_processed(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows of images, and the rows that are kept of them."""
    lake = w5_images(spark, d)
    read = F.from_json("metadata", "width int, height int, format string, mode string")
    catalog = mg.stored(spark, lake.catalog, tb.CATALOG).withColumn("m", read).select("object_name", "object_size", "row_count", "text_extracted", "content_hash", "m.width", "m.height", "m.format", "m.mode")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kept = mg.stored(spark, lake.images, tb.IMAGES).select("object_name", none("object_size", "long"), none("row_count", "int"), none("text_extracted", "boolean"), "content_hash", "width", "height", F.col("img_format").alias("format"), none("mode", "string"))
    return catalog.unionByName(kept)


IMAGES = "(SELECT printf('raw/%010d.png', s_suppkey) AS object_name, s_suppkey % 5 + 1 AS width, s_suppkey % 3 + 2 AS height, s_suppkey % 4 AS grey, s_suppkey FROM supplier)"
SIZED = f"(SELECT *, 54 + ((width * 3 + 3) // 4 * 4) * height AS object_size, min(object_name) OVER (PARTITION BY width, height, grey) AS first FROM {IMAGES})"
LE = lambda x, n: " || ".join(f"printf('%02x', CAST({x} AS BIGINT) // {256**i} % 256)" for i in range(n))
BITMAP = f"unhex('424d' || {LE('object_size', 4)} || '00000000' || '36000000' || '28000000' || {LE('width', 4)} || {LE('height', 4)} || '0100' || '1800' || '00000000' || {LE('object_size - 54', 4)} || repeat('00', 16) || repeat(printf('%02x', grey), CAST(object_size - 54 AS INT)))"
query("w5_processed", w5_processed, f"SELECT object_name, object_size, CASE WHEN object_name <> first THEN 0 END AS row_count, false AS text_extracted, sha256({BITMAP}) AS content_hash, CASE WHEN object_name = first THEN width END AS width, CASE WHEN object_name = first THEN height END AS height, CASE WHEN object_name = first THEN 'BMP' END AS format, CASE WHEN object_name = first THEN 'RGB' END AS mode FROM {SIZED} UNION ALL SELECT object_name, NULL, NULL, NULL, sha256({BITMAP}), width, height, 'BMP', NULL FROM {SIZED} WHERE object_name = first")


def w7_run(spark: SparkSession, d: str) -> DataFrame:
    """Objects of several kinds dispatched to their pipelines, each of which fills the catalog: images by their headers, documents with what was taken out of them."""
    lake = _lake(spark)
    docs = _unit_docs(spark, d).select(F.col("id").alias("doc_no"), F.concat(F.lit("raw/"), "id", F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".pptx", ".bin"))), (F.col("id") % 4 + 1).cast("int"))).alias("object_name"), F.encode("text_content", "UTF-8").alias("content"))
    pictures = v.table(spark, d, "supplier").select(F.lit(None).cast("long").alias("doc_no"), F.concat(F.lit("raw/s"), "s_suppkey", F.lit(".jpg")).alias("object_name"), bitmap(F.col("s_suppkey") % 5 + 1, F.lit(2), F.col("s_suppkey") % 250).alias("content"))
    cells, units = v.cells(spark, d), v.units(spark, d)
    none = cells.select("table_no", F.col("table_no").alias("doc_no"), F.lit(1).cast("long").alias("place"), F.lit(1).cast("long").alias("nth")).filter("false")
    of = lambda files: files.select("doc_no", "object_name", F.octet_length("content").cast("long").alias("object_size"), F.sha2("content", 256).alias("content_hash"))
    taken = lambda kind: lambda files: ex.documents(spark, kind, of(files), units, cells, none, lake, NOW)
    pl.dispatch(docs.unionByName(pictures), {"pdf": taken("pdf"), "docx": taken("docx"), "ppt": taken("pptx"), "image": lambda files: ex.images(spark, files, lake, NOW)})
    return mg.stored(spark, lake.catalog, tb.CATALOG).groupBy("file_format").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("content_hash").alias("contents"), F.sum("object_size").alias("bytes"), F.count_if(F.col("row_count").isNull()).alias("described"))


query("w7_run", w7_run, "SELECT CASE doc_no % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'pptx' END AS file_format, count(*) AS objects, count(DISTINCT t) AS contents, CAST(sum(strlen(t)) AS BIGINT) AS bytes, 0 AS described FROM (SELECT doc_no, min_by(text, pos) AS t FROM units_v GROUP BY doc_no) WHERE doc_no % 4 < 3 GROUP BY 1 UNION ALL SELECT 'image', count(*), count(DISTINCT (s_suppkey % 5, s_suppkey % 250)), CAST(sum(54 + ((s_suppkey % 5 + 1) * 3 + 3) // 4 * 4 * 2) AS BIGINT), count(DISTINCT (s_suppkey % 5, s_suppkey % 250)) FROM supplier")
