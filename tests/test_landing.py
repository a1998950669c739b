"""Objects, landing, archive, first copies, replays and stored tables, on small files."""

import hashlib
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions.images import bitmap, with_image_header
from tidewater.functions.text import OFFICE, mime_type
from tidewater.operators import merge
from tidewater.plans import tables
from tidewater.sources import objects
from tidewater.streaming import ingest

NOW = "2024-02-01 00:00:00"


def put(spark, base, given):
    return objects.put_objects(spark.createDataFrame(list(given.items()), "key string, content string").repartition(3), str(base))


def found(spark, base):
    return {r["key"]: bytes(r["content"]).decode() for r in objects.listed(spark, str(base), contents=True).collect()}


def test_objects_at_their_keys(spark, tmp_path):
    given = {"raw/a.txt": "one", "raw/deep/er/b b.txt": "twö", "c": "3\n"}
    put(spark, tmp_path / "o", given)
    assert found(spark, tmp_path / "o") == given
    put(spark, tmp_path / "o", {"raw/a.txt": "again", "d": "new"})
    assert found(spark, tmp_path / "o") == {**given, "raw/a.txt": "again", "d": "new"}
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["c", "d", "raw"]


@pytest.mark.parametrize("key", ["", "/a", "a/", "a/../../b", "a//b", None])
def test_a_bad_key_fails_the_write_and_leaves_nothing(spark, tmp_path, key):
    put(spark, tmp_path / "o", {"old": "kept"})
    rows = spark.createDataFrame([("good", "x"), (key, "y")], "key string, content string").coalesce(1)
    with pytest.raises(PySparkException):
        objects.put_objects(rows, str(tmp_path / "o"))
    assert found(spark, tmp_path / "o") == {"old": "kept"}
    assert [p for p in Path(tmp_path / "o").rglob("*") if p.is_file() and not p.name.endswith(".crc")] == [tmp_path / "o" / "old"]


def test_what_a_failed_attempt_staged_is_not_published(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, content string")
    staged = objects.stage_objects(rows, str(tmp_path / "staged"))
    attempt = Path(staged) / "0-999"
    attempt.mkdir()
    (attempt / "a").write_text("half")
    assert objects.publish(spark, staged, str(tmp_path / "o")) == 2
    assert found(spark, tmp_path / "o") == {"a": "1", "b": "2"} and not Path(staged).exists()


def test_publishing_goes_on_where_it_stopped(spark, tmp_path):
    staged = objects.stage_objects(spark.createDataFrame([(f"k{i}", str(i)) for i in range(6)], "key string, content string").coalesce(1), str(tmp_path / "staged"))
    (folder,) = (p for p in Path(staged).iterdir() if p.is_dir())
    (tmp_path / "o").mkdir()
    (folder / "k0").rename(tmp_path / "o" / "k0")
    objects.publish(spark, staged, str(tmp_path / "o"))
    assert found(spark, tmp_path / "o") == {f"k{i}": str(i) for i in range(6)}


def test_first_copies_over_batches_and_a_restart(spark, tmp_path):
    catalog, documents, mark = (str(tmp_path / x) for x in ("catalog", "documents", "mark"))
    waves = [{"raw/b.txt": "same", "raw/c.txt": "other"}, {"raw/a.txt": "same", "raw/d.txt": " \n", "raw/e.txt": "other"}, {"raw/g.txt": "new", "raw/f.txt": "same"}]
    for wave in waves:
        put(spark, tmp_path / "in", wave)
        ingest.start_documents(spark, str(tmp_path / "in" / "raw"), catalog, documents, mark, NOW, parts=4).awaitTermination()
    rows = {r["object_name"]: r for r in merge.stored(spark, catalog, tables.CATALOG).collect()}
    assert {k: r["text_extracted"] for k, r in rows.items()} == {"raw/a.txt": False, "raw/b.txt": True, "raw/c.txt": True, "raw/d.txt": False, "raw/e.txt": False, "raw/f.txt": False, "raw/g.txt": True}
    assert {r["row_count"] for r in rows.values()} == {0} and rows["raw/a.txt"]["content_hash"] == hashlib.sha256(b"same").hexdigest()
    assert {r["text_content"]: r["object_name"] for r in merge.stored(spark, documents, tables.DOCUMENTS).collect()} == {"same": "raw/b.txt", "other": "raw/c.txt", "new": "raw/g.txt"}


def test_a_failed_batch_is_made_again(spark, tmp_path):
    put(spark, tmp_path / "in", {f"raw/{i}.txt": f"text {i // 2}" for i in range(6)})
    tried = []

    def between(number):
        tried.append(number)
        if len(tried) < 3:
            raise RuntimeError("fails")

    def start(name, **more):
        return ingest.start_documents(spark, str(tmp_path / "in" / "raw"), str(tmp_path / name / "catalog"), str(tmp_path / name / "documents"), str(tmp_path / name / "mark"), NOW, parts=2, **more)

    assert ingest.until_done(lambda: start("failing", between=between), wait_s=0) == 3 and tried == [0, 0, 0]
    start("whole").awaitTermination()
    rows = lambda name: sorted(map(tuple, merge.stored(spark, str(tmp_path / name / "catalog"), tables.CATALOG).collect()), key=str)
    assert rows("failing") == rows("whole") and len(rows("whole")) == 6
    with pytest.raises(Exception, match="always"):
        ingest.until_done(lambda: start("never", between=lambda n: (_ for _ in ()).throw(RuntimeError("always"))), retries=1, wait_s=0)


def test_files_changed_after_ingest_stay_in_landing(spark, tmp_path):
    put(spark, tmp_path / "in", {"raw/a.txt": "a", "raw/b.txt": "b"})
    folder, args = str(tmp_path / "in" / "raw"), (str(tmp_path / "catalog"), str(tmp_path / "mark"))
    ingest.start_ingest(spark, folder, *args, archive=str(tmp_path / "archive")).awaitTermination()
    put(spark, tmp_path / "in", {"raw/b.txt": "longer"})
    assert ingest.swept(spark, folder, *args, str(tmp_path / "archive")) == 1
    assert list(found(spark, folder)) == ["b.txt"]
    assert ingest.swept(spark, folder, *args, str(tmp_path / "archive")) == 0


def test_upserts_leave_other_partitions_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    rows = spark.range(200).selectExpr("id AS k", "'old' AS v")
    change = lambda current, new: merge.upsert(current, new, ["k"], ["v"])
    assert len(merge.upsert_stored(spark, path, schema, ["k"], rows, change, 8)) == 8
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    touched = merge.upsert_stored(spark, path, schema, ["k"], spark.createDataFrame([(7, "new"), (None, "lost")], schema), change, 8)
    assert len(touched) == 1
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert {p for p in before if f"part={touched[0]}/" not in str(p)} == {p for p in after if f"part={touched[0]}/" not in str(p)}
    assert {p: t for p, t in after.items() if p in before} == {p: t for p, t in before.items() if p in after}
    assert {r["v"] for r in merge.stored(spark, path, schema).filter("k <> 7").collect()} == {"old"} and merge.stored(spark, path, schema).count() == 200
    plan = merge.stored(spark, path, schema).filter("part = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def test_image_headers(spark):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 70000, 3, 8, 6, 0, 0, 0))
    frame = segment(0xC2, struct.pack(">BHHB", 8, 480, 640, 3) + b"\1\x11\0" * 3)
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + segment(0xE1, b"\xff\xc0" * 30000) * 3 + segment(0xC4, b"t" * 20) + b"\xff\xff" + frame + b"data"
    top_down = b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 5, -7, 1, 8)
    given = [("png", png, ("PNG", 70000, 3, "RGBA")), ("jpeg", jpeg, ("JPEG", 640, 480, "RGB")), ("bmp", top_down, ("BMP", 5, 7, "P")), ("cut", jpeg[:50], (None,) * 4), ("text", b"BMW", (None,) * 4), ("empty", b"", (None,) * 4), ("null", None, (None,) * 4)]
    rows = with_image_header(spark.createDataFrame([g[:2] for g in given], "name string, content binary")).drop("content").collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {g[0]: g[2] for g in given}
    made = spark.range(3).select(bitmap(F.col("id") + 1, F.col("id") + 5, F.lit(7)).alias("content"))
    assert [tuple(r)[1:] for r in with_image_header(made).collect()] == [("BMP", i + 1, i + 5, "RGB") for i in range(3)]


def test_packed_office_files_by_their_names(spark):
    rows = [(f"PK\3\4 [Content_Types].xml {name.decode()}document.xml".encode(), mime) for name, mime in OFFICE] + [(b"PK\3\4 a.txt", "application/zip"), (b"word/", "text/plain")]
    got = spark.createDataFrame(rows, "content binary, wanted string").select("wanted", mime_type(F.col("content")).alias("m")).collect()
    assert all(r["m"] == r["wanted"] for r in got)
