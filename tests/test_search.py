"""Records of mixed shape, and search by trigrams."""

import random

from pyspark.sql import functions as F

from tidewater.operators import records, search
from tidewater.operators.catalog import containing
from tidewater.sources import files


def flat(spark, rows):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").coalesce(1)
    found = records.flattened_records(frame.select(F.parse_json("v").alias("record")))
    return dict(found.dtypes), [r.asDict() for r in found.collect()]


def test_mixed_records(spark):
    types, rows = flat(spark, ['{"a":{"b":1,"c":{"d":2}},"e":[1]}', '{"a":3}'])
    assert types == {"e": "array<bigint>", "a": "bigint", "a.b": "bigint", "a.c.d": "bigint"}
    assert rows == [{"e": [1], "a": None, "a.b": 1, "a.c.d": 2}, {"e": None, "a": 3, "a.b": None, "a.c.d": None}]


def test_records_of_many_shapes(spark):
    types, rows = flat(spark, ['{"a":{"b":1}}', '{"a":{"b":{"x y":"z"}}}', '{"a":"t","n":null}', '{"a":[1,{"k":2}]}', '{"a":{"b":true}}', "{}"])
    assert types == {"n": "string", "a": "string", "a.b": "string", "a.b.x y": "string"}
    assert [r["a"] for r in rows] == [None, None, "t", '[1,{"k":2}]', None, None] and [r["a.b"] for r in rows] == ["1", None, None, None, "true", None]
    assert [r["a.b.x y"] for r in rows] == [None, "z", None, None, None, None] and all(r["n"] is None for r in rows)


def test_mixed_json_files(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":{"b":1}}\nbad\n{"a":2}\n7\n')
    (tmp_path / "array.json").write_text('[\n{"a":{"b":3}},\n{"a":"x"}\n]')
    (tmp_path / "one.json").write_text('{\n"a": {"c": [1]}\n}')
    found = files.flat_json(spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.select("a", "`a.b`", "`a.c`").collect()), key=str) == sorted([(None, 1, None), ("2", None, None), (None, 3, None), ("x", None, None), (None, None, [1])], key=str)


def test_search_equals_a_scan(spark, tmp_path):
    r = random.Random(2)
    texts = ["".join(r.choice("abÄé \n%_\\") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", "ab", "x" * 200_000 + "needle"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text_content string").repartition(3)
    index = search.build_index(docs, str(tmp_path / "index"), parts=3)
    for pattern in ("aba", "BÄA", "a_bé", "éa%ab", "ab", "needle", "nothing here", "a\\%b", "bb\\_a", "a\nb", "%", "aba%aba"):
        found = sorted(x["id"] for x in search.indexed(docs, index, pattern, parts=3).collect())
        assert found == sorted(x["id"] for x in docs.filter(containing("text_content", pattern)).collect()), pattern
    assert search.candidates(spark, index, "needle", parts=3).count() == 1
    docs.write.parquet(str(tmp_path / "docs"))
    plan = search.indexed(spark.read.parquet(str(tmp_path / "docs")), index, "needle", parts=3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [303])" in plan or "EqualTo(id,303)" in plan
