"""Files are listed and read by tasks, as Spark's own reader lists and reads them."""

from pyspark.sql import functions as F

from tests.test_scale import plan, rows
from tidewater.sources import files, objects


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    given = {"a b.txt": b"one", "deep/er/c%20d.txt": b"\xff\0two", "deep/_k=v/e": b"3", "empty": b"", "_hidden": b"x", ".dot/f": b"x", "deep/_off/g": b"x"}
    for key, content in given.items():
        path = tmp_path / "in" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    base = str(tmp_path / "in")
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    for at in (base, f"file://{base}", f"{base}/"):
        found = files.objects(spark, at).select(theirs.columns)
        assert rows(found) == rows(theirs) and len(rows(found)) == 3
        assert rows(files.landing(spark, at)) == rows(theirs.select("path", "length", "modificationTime"))
        assert "binaryFile" not in plan(found)[1] and "MapInArrow" in plan(found)[1]
    assert {r["key"]: bytes(r["content"]) for r in objects.listed(spark, base, contents=True).collect()} == {k: given[k] for k in ("a b.txt", "deep/er/c%20d.txt", "deep/_k=v/e")}
    # a file, a pattern and several folders are left to Spark
    assert files.landing(spark, f"{base}/a b.txt").count() == 1 and files.landing(spark, f"{base}/*/er").count() == 1 and files.landing(spark, [f"{base}/deep", f"{base}/deep/er"]).count() >= 2
    (tmp_path / "none").mkdir()
    assert files.objects(spark, str(tmp_path / "none")).count() == 0


def test_contents_come_in_batches_of_bytes(spark, tmp_path, monkeypatch):
    for i in range(20):
        (tmp_path / f"{i}").write_bytes(bytes([i]) * (i * 10 + 1))
    monkeypatch.setattr(objects, "BATCH_BYTES", 64)
    monkeypatch.setattr(objects, "TASK_BYTES", 500)
    found = files.objects(spark, str(tmp_path)).select(F.octet_length("content").alias("n"), "length", F.sha2("content", 256).alias("h"))
    assert found.filter("n <> length").count() == 0 and found.count() == 20 and found.select("h").distinct().count() == 20
