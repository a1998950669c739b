"""Structured files with odd headers and quotes, loads that fail, extracted tables and images, on small files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions.images import bitmap
from tidewater.operators import assemble, clean, merge
from tidewater.plans import extraction, tables
from tidewater.sources import files, objects, writers

NOW = "2024-02-01 00:00:00"


def values(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_repeated_and_empty_header_names(spark, tmp_path):
    assert files.header_names('a,b,a,,"x, y",A', ",") == ["a", "b", "a_1", "Unnamed: 3", "x, y", "A_2"]
    (tmp_path / "x.csv").write_text("a,b,a\n1,2,3\n")
    found = clean.clean_frame(files.structured(spark, str(tmp_path)))
    assert found.columns == ["a", "b", "a_1"] and values(found) == [("1", "2", "3")]


def test_parts_of_unlike_headers_are_matched_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nX,2\n")
    (tmp_path / "y.csv").write_text("b,a\n3,Y\n")
    (tmp_path / "z.csv").write_text("a,c\nZ,4\n")
    (tmp_path / "l.csv").write_bytes("a;é\nL;ü\n".encode("latin-1"))
    found = files.structured(spark, str(tmp_path))
    assert values(found.select("a", "b", "c", "é")) == sorted([("X", "2", None, None), ("Y", "3", None, None), ("Z", None, "4", None), ("L", None, None, "ü")], key=str)


def test_short_rows_with_backslashes_are_kept(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n"x\\","y, z, w, v"\n1,2,3\n"q ""r"" s",5,6,7\n')
    found = files.tolerant_csv(spark, str(tmp_path / "x.csv"), ["a", "b", "c"])
    assert values(found) == sorted([("x\\", "y, z, w, v", None), ("1", "2", "3")], key=str)


def test_only_files_with_open_quotes_are_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('a,b\n"one\ntwo",2\n')
    (tmp_path / "b.csv").write_text("a,b\n3,4\n5,6\n")
    asked, made = [], files._delimited
    monkeypatch.setattr(files, "_delimited", lambda spark, paths, width, delimiter, charset, quoting, lines: asked.append((lines, [str(p)[-5:] for p in paths])) or made(spark, paths, width, delimiter, charset, quoting, lines))
    found = files.tolerant_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["a", "b"])
    assert values(found) == sorted([("one\ntwo", "2"), ("3", "4"), ("5", "6")], key=str)
    assert asked == [(False, ["b.csv"]), (True, ["a.csv"])]


def test_large_json_files_are_told_by_their_second_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 10)
    (tmp_path / "cut.json").write_text('{"a":1,"b\n{"a":2}\n{"a":3}\n')
    (tmp_path / "doc.json").write_text('{\n"a": 4\n}\n')
    assert sorted(r["a"] for r in files.any_json(spark, str(tmp_path)).filter("a is not null").collect()) == [2, 3, 4]


def test_a_failed_load_keeps_the_table(spark, tmp_path):
    name, path = "kept_table", str(tmp_path / "t")
    writers.replace_table(spark.createDataFrame([(1, "a")], "k int, v string"), name, path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("int").alias("k"), F.lit("b").alias("v"))
    with pytest.raises(PySparkException):
        writers.replace_table(bad, name, path)
    assert values(spark.table(name)) == [(1, "a")]
    writers.replace_table(spark.createDataFrame([(2, "c")], "k int, v string"), name, path)
    assert values(spark.table(name)) == [(2, "c")]
    writers.replace_table(spark.createDataFrame([(3.5,)], "w double"), name, path)
    assert values(spark.table(name)) == [(3.5,)] and spark.table(name).columns == ["w"]
    spark.sql(f"DROP TABLE {name}")


def lake(tmp_path):
    return extraction.Lake(*(str(tmp_path / x) for x in ("objects", "tables", "catalog", "documents", "images")), parts=2)


def test_documents_to_the_end(spark, tmp_path):
    docs = spark.createDataFrame([(1, "raw/b.docx", 3, "h1"), (2, "raw/a.docx", 4, "h2"), (3, "raw/c.docx", 3, "h1"), (4, "raw/d.docx", 9, "h4")], "doc_no long, object_name string, object_size long, content_hash string")
    units = spark.createDataFrame([(1, 0, "body", "one"), (1, 1, "body", " "), (1, 2, "body", "two"), (2, 0, "body", "x"), (3, 0, "body", "one"), (4, 0, "body", " \n")], "doc_no long, pos long, kind string, text string")
    grid = {10: [["Id", "When", "Id"], ["1", "2024-01-05", ' a,"b"'], ["22", "2024-02-01", None]], 11: [["Id", "When", "Id"], ["3", "2024-03-01", "z"]], 20: [["only header"]], 21: [["A"], [" "]], 30: [["lost"], ["1"]]}
    cells = spark.createDataFrame([(t, i, j, x) for t, rows in grid.items() for i, row in enumerate(rows) for j, x in enumerate(row)], "table_no long, row_no long, col_no int, text string")
    of = spark.createDataFrame([(10, 1, 1, 1), (11, 1, 1, 2), (20, 2, 1, 1), (21, 2, 1, 2), (30, 3, 1, 1)], "table_no long, doc_no long, place long, nth long")
    where = lake(tmp_path)
    made = extraction.documents(spark, "docx", docs, units, cells, of, where, NOW, facts={"author": F.lit("someone")})
    assert sorted((r["table_name"], r["n_rows"]) for r in made.collect()) == [("data_b_table_1", 2), ("data_b_table_2", 1)]
    path = {r["table_no"]: r["path"] for r in made.collect()}
    first = spark.read.parquet(path[10])
    assert first.dtypes == [("id", "int"), ("when", "timestamp_ntz"), ("id_2", "string")] and first.count() == 2
    assert len({p.rsplit("/", 1)[0] for p in path.values()}) == 1
    kept = {r["key"]: bytes(r["content"]).decode() for r in objects.listed(spark, where.base, contents=True).collect()}
    assert kept == {
        "processed/unstructured/text-extracted/b.txt": "one\ntwo",
        "processed/unstructured/text-extracted/a.txt": "x",
        "processed/structured/docx-tables/b_table_1.csv": 'id,when,id_2\n1,2024-01-05,"a,""b"""\n22,2024-02-01,\n',
        "processed/structured/docx-tables/b_table_2.csv": "id,when,id_2\n3,2024-03-01,z\n",
    }
    rows = {r["object_name"]: r for r in merge.stored(spark, where.catalog, tables.CATALOG).collect()}
    assert {k: (r["row_count"], r["text_extracted"]) for k, r in rows.items()} == {"raw/b.docx": (3, True), "raw/a.docx": (0, True), "raw/c.docx": (0, False), "raw/d.docx": (0, False), "processed/structured/docx-tables/b_table_1.csv": (2, False), "processed/structured/docx-tables/b_table_2.csv": (1, False)}
    described = json.loads(rows["raw/b.docx"]["metadata"])
    assert (described["author"], described["paragraph_count"], described["table_count"]) == ("someone", 3, 2) and rows["raw/c.docx"]["metadata"] is None
    # the same again changes only times; a copy that lands later is one too, and its tables are not loaded
    extraction.documents(spark, "docx", docs, units, cells, of, where, NOW)
    again = {r["object_name"]: r for r in merge.stored(spark, where.catalog, tables.CATALOG).collect()}
    assert {k: (r["row_count"], r["text_extracted"], r["content_hash"]) for k, r in again.items()} == {k: (r["row_count"], r["text_extracted"], r["content_hash"]) for k, r in rows.items()}
    late = spark.createDataFrame([(9, "raw/0.docx", 3, "h1")], docs.schema)
    extraction.documents(spark, "docx", late, units, cells, of, where, NOW)
    assert merge.stored(spark, where.catalog, tables.CATALOG).filter("object_name = 'raw/0.docx'").first()["text_extracted"] is False
    assert merge.stored(spark, where.documents, tables.DOCUMENTS).filter("content_hash = 'h1'").first()["object_name"] == "raw/b.docx"


def test_keys_of_tables(spark):
    key = lambda kind: spark.range(1).select(assemble.table_key(kind, F.lit("f"), F.lit(3), F.lit(2))).first()[0]
    assert [key(k) for k in ("pdf", "docx", "pptx")] == ["processed/structured/pdf-tables/f_page3_table2.csv", "processed/structured/docx-tables/f_table_2.csv", "processed/structured/ppt-tables/f_slide3_table2.csv"]


def test_images_to_the_end(spark, tmp_path):
    made = spark.createDataFrame([("raw/a.png", 2), ("raw/b.png", 3), ("raw/c.png", 2)], "object_name string, w int").select("object_name", bitmap(F.col("w"), F.lit(4), F.lit(1)).alias("content"))
    broken = spark.createDataFrame([("raw/x.png", b"no image")], "object_name string, content binary")
    where = lake(tmp_path)
    extraction.images(spark, made.unionByName(broken), where, NOW)
    kept = merge.stored(spark, where.images, tables.IMAGES).collect()
    assert sorted((r["object_name"], r["img_format"], r["width"], r["height"]) for r in kept) == [("raw/a.png", "BMP", 2, 4), ("raw/b.png", "BMP", 3, 4)]
    rows = {r["object_name"]: r for r in merge.stored(spark, where.catalog, tables.CATALOG).collect()}
    assert set(rows) == {"raw/a.png", "raw/b.png", "raw/c.png"} and rows["raw/c.png"]["row_count"] == 0 and rows["raw/a.png"]["row_count"] is None
    assert json.loads(rows["raw/b.png"]["metadata"]) == {"width": 3, "height": 4, "format": "BMP", "mode": "RGB", "exif": {}}
