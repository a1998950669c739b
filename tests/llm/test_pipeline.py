"""The pipeline on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from tests.llm.edge import CLASHING, documents


@pytest.fixture
def folder(spark, tmp_path):
    def make(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, 1, int(i == 17)) for i in range(1, 19)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([("b1", "a benchmark passage of words"), (None, None), ("b2", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_odd_rows(spark, folder):
    path = folder(documents(spark))
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x or 0))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{path}/{name}"
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        columns = columns or docs.columns
        assert docs.columns == columns and set(CLASHING) < set(columns)
        left[name] = ids(docs)
    # copies 2, 3 and 4 of 1, and 9 of 8, are gone; everything else stays, null ids and both rows of 15 too
    assert left["near_dedup"] == [1, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 15, 16, 17, 18, None, None] == left["mixing"]
    rows = corpus_pipeline.run(spark, path).collect()
    assert ids(spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long")) == left["mixing"]
    assert sorted(r["n_tokens"] for r in rows)[:2] == [1, 1] and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)


def test_empty_table(spark, folder):
    path = folder(documents(spark, []).limit(0))
    assert corpus_pipeline.run(spark, path).collect() == []
