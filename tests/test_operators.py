"""Rules that SQL over the given tables does not reach, on small frames."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions.text import column_name, mime_type, table_name, upload_key
from tidewater.operators import assemble, catalog, clean, infer, merge
from tidewater.plans import pipelines
from tidewater.sources import files, objects
from tidewater.streaming import ingest


def values(frame):
    return [tuple(r) for r in frame.collect()]


def column(spark, items, make):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(make(F.col("x"))).collect()]


def test_names(spark):
    given, wanted = [" 1st Col! ", "naïve col", "!!!", "", "A  b\tc", "_x_"], ["col_1st_col", "naïve_col", "unnamed_column", "unnamed_column", "a_b_c", "x"]
    assert [clean.clean_name(x) for x in given] == wanted
    assert column(spark, given, column_name) == wanted
    assert clean.numbered(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert clean.numbered(["a", "a", "col", "a"], 2) == ["a", "a_2", "col", "a_3"]
    assert column(spark, ["raw/x/My File-1.csv", f"raw/{'y' * 80}.csv"], table_name) == ["data_my_file_1", "data_" + "y" * 58]
    assert column(spark, ["raw/a.PDF", "b.xyz"], upload_key) == ["raw/pdf/a.PDF", "raw/other/b.xyz"]


def test_null_tokens_are_exact(spark):
    frame = spark.createDataFrame([(x,) for x in ("NA", " null ", "na", "None", "  ")], "v string")
    assert [r[0] for r in clean.null_tokens(clean.trim_all(frame)).collect()] == [None, None, "na", None, None]


def test_clean_chain_twice_is_once(spark):
    frame = spark.createDataFrame([(" a ", "N/A"), (None, None), ("NULL", " b")], "`X 1` string, `X 1!` string")
    once = clean.clean_frame(frame)
    assert once.columns == ["x_1", "x_1_1"]
    assert values(once) == values(clean.clean_frame(once).union(once.limit(0))) or values(once)[-1] == (None, "b")
    assert values(once) == [("a", None), (None, "b")]


def test_inferred_types(spark):
    rows = [("0", "true", "1.0", "2024-01-15", '{"a": 1}', "3000000000", "1.5", "x", None, "Yes"), ("1", "false", None, "2024-02-01", "[1]", "1", "2", "1", None, "maybe"), ("0", "true", "3.0", None, None, "2", "-3.25", None, None, "no")]
    frame = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(10)))
    assert list(infer.infer_types(frame).values()) == ["INTEGER", "BOOLEAN", "INTEGER", "TIMESTAMP", "JSONB", "BIGINT", "NUMERIC", "TEXT", "TEXT", "TEXT"]
    typed = infer.cast_typed(frame)
    assert [t for _, t in typed.dtypes][:7] == ["int", "boolean", "int", "timestamp_ntz", "string", "bigint", "decimal(3,2)"]
    assert typed.filter("c2 = 3").count() == 1
    assert infer.infer_types(spark.createDataFrame([(True,)], "b boolean")) == {"b": "BOOLEAN"}
    assert infer.infer_types(frame.limit(0))["c0"] == "TEXT"
    three = spark.createDataFrame([("yes",), ("no",), ("t",)], "b string")
    assert infer.infer_types(three) == {"b": "TEXT"}


def test_upsert_rules(spark):
    schema = "catalog_id long, bucket_name string, object_name string, object_size long, file_format string, row_count int, text_extracted boolean, content_hash string, last_modified timestamp_ntz, uploaded_by int, metadata string"
    old = spark.createDataFrame([(1, "l", "a", 5, "csv", 1, False, "h", None, 7, "{}"), (2, "l", "b", 6, "csv", 1, False, "i", None, 8, "{}")], schema)
    new = spark.createDataFrame([(9, "l", "a", 50, "csv", 2, True, "h2", None, None, "{}"), (3, "l", "c", 1, "pdf", 0, False, "k", None, 1, "{}"), (4, None, "x", 1, "pdf", 0, False, "k", None, 1, "{}")], schema)
    once = merge.upsert_catalog(old, new, "2024-02-01 00:00:00")
    rows = {r["object_name"]: r for r in once.collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"]["catalog_id"], rows["a"]["object_size"], rows["a"]["uploaded_by"], rows["a"]["content_hash"]) == (1, 50, 7, "h2")
    assert rows["a"]["last_modified"] is not None and rows["b"]["last_modified"] is None and rows["c"]["last_modified"] is None
    twice = merge.upsert_catalog(once, new, "2024-02-01 00:00:00").drop("last_modified")
    assert sorted(values(twice)) == sorted(values(once.drop("last_modified")))


def test_lookups_and_ids(spark):
    files_ = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2"), ("d", None)], "object_name string, content_hash string")
    known = spark.createDataFrame([("a", "h1"), ("c", "h2"), ("z", None)], "object_name string, content_hash string")
    new, seen = merge.new_only(files_, known), merge.seen_only(files_, known)
    assert sorted(r[0] for r in new.collect()) == ["a", "c", "d"] and [r[0] for r in seen.collect()] == ["b"]
    ids = merge.assign_ids(spark.range(0, 500).withColumnRenamed("id", "k").repartition(7), ["k"], 10)
    assert sorted((r["k"], r["id"]) for r in ids.collect()) == [(k, k + 10) for k in range(500)]
    docs = spark.createDataFrame([(1, "b", "t"), (2, "a", "t"), (3, "c", None)], "id long, object_name string, text_content string")
    assert sorted((r["id"], r["is_duplicate"]) for r in merge.dedup_exact(docs.filter("id < 3")).collect()) == [(1, True), (2, False)]


def test_scopes_add_up(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(40)], "catalog_id long, uploaded_by int")
    own = sum(catalog.scoped(rows, u, "user").count() for u in range(3))
    assert own == catalog.scoped(rows).count() - 10
    assert catalog.extraction_rate(rows.withColumns({"file_format": F.lit("csv"), "text_extracted": F.lit(True)})).first()["rate"] == 0


def test_ragged_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    assert values(files.tolerant_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])) == [("1", "2"), ("3", None), ("7", "8")]
    (tmp_path / "n.json").write_text('{"a":1}\nbad\n{"a":2}\n')
    (tmp_path / "o.json").write_text('{"a":1,\n "b":{"c":2}}')
    (tmp_path / "l.json").write_text('[{"a":{"b":1,"c":{"d":2}},"e":[1]},\n {"a":{"b":3}}]')
    assert sorted(r[0] for r in files.any_json(spark, str(tmp_path / "n.json")).filter("a is not null").select("a").collect()) == [1, 2]
    one = clean.flattened(files.any_json(spark, str(tmp_path / "o.json")))
    assert one.columns == ["a", "b.c"] and one.count() == 1
    assert clean.flattened(files.any_json(spark, str(tmp_path / "l.json"))).columns == ["a.b", "a.c.d", "e"]


def test_csv_quotes_and_long_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,2,3\n4,5,6,\n7\n11,"x\ny",12\n13,"q, ""r""",14\n15,,\n"16","1,2","3",x\n')
    got = files.tolerant_csv(spark, str(tmp_path / "a.csv"), ["a", "b", "c"])
    assert values(got) == [("1", "2", "3"), ("7", None, None), ("11", "x\ny", "12"), ("13", 'q, "r"', "14"), ("15", None, None)]
    assert got.count() == 5 and got.select("b").filter("b IS NULL").count() == 2


def test_json_files_are_told_apart_one_by_one(spark, tmp_path):
    for i, text in enumerate(['[\n {"a":1},\n {"a":2}\n]', '{"a":3}\n{"a":4}\n', '{"a":"x",\n"b":{"c":1}}', '{"a":1,"b"\n{"a":5}\n']):
        (tmp_path / f"{i}.json").write_text(text)
    assert sorted(r["a"] for r in files.any_json(spark, str(tmp_path)).filter("a IS NOT NULL").collect()) == ["1", "2", "3", "4", "5", "x"]


def test_landed_parts_of_several_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k;v\né;2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("k,v\nß,3\n")
    (tmp_path / "c.json").write_text('{"k":"j","v":4}\n')
    spark.createDataFrame([("p", "5")], "k string, v string").write.parquet(str(tmp_path / "d.parquet"))
    assert sorted(values(files.structured(spark, str(tmp_path)).select("k", "v"))) == [("j", "4"), ("p", "5"), ("ß", "3"), ("é", "2")]


def test_casts_keep_values(spark):
    rows = spark.createDataFrame([("1.5e-3", "12345678901234567890", "2024-01-05", "5.0"), ("2.25", "7", "2024-01-31", "6"), (None, None, "2024-1-31 10:00", None)], "e string, big string, t string, i string")
    assert infer.infer_types(rows) == {"e": "NUMERIC", "big": "NUMERIC", "t": "TIMESTAMP", "i": "INTEGER"}
    got = infer.cast_typed(rows).select("e", F.col("big").cast("string"), F.to_date("t").cast("string"), "i")
    assert values(got) == [(0.0015, "12345678901234567890", "2024-01-05", 5), (2.25, "7", "2024-01-31", 6), (None, None, "2024-01-31", None)]
    assert infer.infer_types(spark.createDataFrame([("2024-02-30",), ("2024-13-01",)], "t string")) == {"t": "TEXT"}


#: Values of a column, and the times that they are; none for columns that are no times.
TIMES = [
    (["2024-01-15T10:00:00Z", "2024-01-15T10:00:00+02:00"], ["2024-01-15 10:00:00", "2024-01-15 10:00:00"]),
    (["2024-01-15 10:00:00.123", "2024-01-15"], ["2024-01-15 10:00:00.123", "2024-01-15 00:00:00"]),
    (["2024/01/15", "2024/1/5 9:30"], ["2024-01-15 00:00:00", "2024-01-05 09:30:00"]),
    (["1/5/2024", "12/31/2024"], ["2024-01-05 00:00:00", "2024-12-31 00:00:00"]),
    (["1/5/2024", "31/12/2024"], ["2024-05-01 00:00:00", "2024-12-31 00:00:00"]),
    (["13/01/2024", "01/13/2024"], None),
    (["2024-01-15", "2024/01/15"], None),
    (["Jan 15, 2024", "February 3, 2024"], ["2024-01-15 00:00:00", "2024-02-03 00:00:00"]),
    (["15 Jan 2024", "3-Sept-2024"], ["2024-01-15 00:00:00", "2024-09-03 00:00:00"]),
    (["01/02/2024 12:30 AM", "01/02/2024 10:30 PM"], ["2024-01-02 00:30:00", "2024-01-02 22:30:00"]),
    (["2024-01-15 25:00"], None),
    (["Foo 15, 2024"], None),
    (["2024-01-15", "soon"], None),
    (["31.01.2024", "28.02.2024"], ["2024-01-31 00:00:00", "2024-02-28 00:00:00"]),
]


@pytest.mark.parametrize("given, wanted", TIMES)
def test_times_of_one_format(spark, given, wanted):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*given, None])], "i int, t string")
    assert infer.infer_types(rows)["t"] == ("TIMESTAMP" if wanted else "TEXT")
    if wanted:
        got = [r[0] for r in infer.cast_typed(rows).orderBy("i").select(F.col("t").cast("string")).collect()]
        assert got == [*wanted, None]


def test_bounds_of_whole_numbers(spark):
    rows = spark.createDataFrame([("9223372036854775807", "9223372036854775808", "2147483647", "-2147483649", "007", "-1.25")], "a string, b string, c string, d string, e string, f string")
    assert infer.infer_types(rows) == {"a": "BIGINT", "b": "NUMERIC", "c": "INTEGER", "d": "BIGINT", "e": "INTEGER", "f": "NUMERIC"}
    assert dict(infer.cast_typed(rows).dtypes)["b"] == "decimal(19,0)" and values(infer.cast_typed(rows).select("a", "f"))[0][0] == 2**63 - 1


def test_ids_of_many_wide_rows_are_consecutive(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(400_000).select((F.col("id") % 100_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        ids = merge.assign_ids(rows, ["k"], 1)
        facts = ids.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(facts) == (400_000, 400_000, 1, 400_000)
        assert ids.filter((F.col("id") - 1 < 4 * F.col("k")) | (F.col("id") > 4 * F.col("k") + 4)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_names_with_dots(spark):
    rows = spark.createDataFrame([(float("nan"), [1])], "`a.b` double, `c.d` array<int>")
    assert values(clean.nan_to_null(rows)) == [(None, [1])] and clean.complex_to_json(rows).first()["c.d"] == "[1]"


def test_another_checkpoint_keeps_what_is_catalogued(spark, tmp_path):
    landing, out = tmp_path / "raw", str(tmp_path / "catalog")
    landing.mkdir()
    (landing / "a.csv").write_text("a")
    ingest.start_ingest(spark, str(landing), out, str(tmp_path / "one"), archive=str(tmp_path / "archive")).awaitTermination()
    assert ingest.swept(spark, str(landing), out, str(tmp_path / "one"), str(tmp_path / "archive")) == 1
    (landing / "b.csv").write_text("b")
    ingest.start_ingest(spark, str(landing), out, str(tmp_path / "two"), archive=str(tmp_path / "archive")).awaitTermination()
    assert sorted(r["object_name"] for r in ingest.current_catalog(spark, out).collect()) == ["raw/a.csv", "raw/b.csv"]
    assert ingest.swept(spark, str(landing), out, str(tmp_path / "two"), str(tmp_path / "archive")) == 1
    assert sorted(r["key"][-5:] for r in objects.listed(spark, str(tmp_path / "archive")).collect()) == ["a.csv", "b.csv"] and not list(landing.iterdir())


def test_metadata_has_all_fields(spark):
    got = column(spark, ["3"], lambda c: text.metadata("pdf", page_count=c.cast("int")))
    assert json.loads(got[0])["page_count"] == 3 and len(json.loads(got[0])) == 8
    with pytest.raises(ValueError, match="wings"):
        text.metadata("pdf", wings=F.lit(1))


def test_delimiters(spark):
    texts = ["a;b;c\n1;2;3", "a|b\n1|2\n", "no candidates here", "", None, "a,b;c\n1,2;3", "a\tb\tc\n\n1\t2\t3"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r["delimiter"] for r in files.delimiters(frame, "id", "t").orderBy("id").collect()] == [";", "|", ",", ",", ",", ",", "\t"]


def _png(width, height):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + b"\0\0\0" * width) * height)) + part(b"IEND", b"")


def test_images_and_mime(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png(4, 3))
    (tmp_path / "b.png").write_bytes(b"not an image")
    assert [(r["width"], r["height"], r["nChannels"]) for r in files.images(spark, str(tmp_path)).collect()] == [(4, 3, 3)]
    found = {r["path"][-5:]: r["m"] for r in files.objects(spark, str(tmp_path)).select("path", mime_type(F.col("content")).alias("m")).collect()}
    assert found == {"a.png": "image/png", "b.png": "text/plain"}
    assert {r["object_name"] for r in files.drop_folder(spark, str(tmp_path)).collect()} == {"raw/a.png", "raw/b.png"}


def test_documents_and_tables(spark):
    units = spark.createDataFrame([(1, 0, "title", "T"), (1, 1, "body", " "), (1, 2, "body", "b"), (1, 3, "notes", "n"), (2, 0, "body", "x")], "doc_no long, pos long, kind string, text string")
    assert {r["doc_no"]: r["text"] for r in assemble.deck_text(units).collect()} == {1: "SLIDE 1: T\n\nb\n\nNotes: n", 2: "x"}
    docs = spark.createDataFrame([(1, "p", "same"), (2, "q", "same")], "id long, object_name string, text_content string")
    rows = {r["doc_no"]: r for r in pipelines.documents(docs, units).collect()}
    assert rows[1]["text"] == "T\nb\nn" and rows[2]["is_duplicate"] and rows[2]["text"] is None and rows[2]["n_units"] == 0
    cells = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "A"), (1, 0, 2, ""), (1, 0, 3, "A"), (1, 1, 0, " 1 "), (1, 1, 1, "yes"), (1, 2, 0, " "), (2, 0, 0, "alone")], "table_no long, row_no long, col_no int, text string")
    assert [r["col_name"] for r in assemble.headers(cells.filter("table_no = 1"), 2, "col").orderBy("col_no").collect()] == ["a", "a_2", "col", "a_3"]
    typed = [(r["table_no"], r["col_name"], r["inferred_type"]) for r in assemble.typed_tables(cells).orderBy("col_no").collect()]
    assert typed == [(1, "a", "INTEGER"), (1, "a_1", "BOOLEAN")]


def test_empty_file_is_an_error(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        pipelines.structured_file(spark, str(tmp_path / "e.csv"), "never", str(tmp_path / "out"))


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    landing, out, mark = tmp_path / "raw", str(tmp_path / "catalog"), str(tmp_path / "mark")
    landing.mkdir()
    for i in range(5):
        (landing / f"f{i}.csv").write_text(f"a\n{i // 2}\n")
    for _ in range(2):
        ingest.start_ingest(spark, str(landing), out, mark).awaitTermination()
        (landing / "late.pdf").write_text("late")
    batch = ingest.catalog_rows(files.objects(spark, str(landing))).select("object_name", "content_hash", "route")
    assert sorted(values(ingest.current_catalog(spark, out).select("object_name", "content_hash", "route"))) == sorted(values(batch))
    fresh = str(tmp_path / "fresh")
    ingest.start_new_content(spark, str(landing), fresh, str(tmp_path / "mark2")).awaitTermination()
    assert spark.read.parquet(fresh).count() == 4


def test_json_lines_are_told_by_first_lines(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text('{"a":%d}\n' % i * 3 if i else '{broken\n{"a":0}\n')
    reader, asked = type(spark.read), []
    text = reader.text
    monkeypatch.setattr(reader, "text", lambda self, *a, **k: asked.append(k.get("wholetext", False)) or text(self, *a, **k))
    assert files.any_json(spark, str(tmp_path)).filter("a is not null").count() == 7
    assert asked == [False]
